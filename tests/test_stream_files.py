"""What a stream of many crawls writes grows with its tasks, and rows come through it as they are."""

import datetime
import glob

from pyspark.sql import functions as F

from crawlens.streaming import jobs


def test_files_do_not_grow_with_crawls(spark, tmp_path):
    crawls, pages = 40, 12
    schema = "crawl_id string, url string, fetch_seq bigint, fetched_at timestamp, status_code int, event string"
    at = datetime.datetime(2024, 1, 1, 2, 3, 4, 5)
    rows = [(f"c{c}", f"http://s/{i}", None if i % 2 else i, None if i % 3 else at, 200, None) for c in range(crawls) for i in range(pages)]
    ends = [(f"c{c}", None, None, None, 0, jobs.END) for c in range(crawls)]
    for some in (rows, rows[::5] + ends):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    columns = {"html": "''", "base_url": "'http://s'", "content_type": "'text/html'", "redirect_count": "0", "final_url": "url", "x_robots_tag": "cast(null as string)"}
    arriving = jobs.read_fetches(spark, f"{tmp_path}/in", schema, files_per_trigger=1).selectExpr("*", *[f"{v} as {k}" for k, v in columns.items()])
    adaptive = []

    def run(ended, facts):
        adaptive.append(facts.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        return facts.select("crawl_id", "url", "fetch_seq", "fetched_at").repartition(8, F.xxhash64("url"))

    jobs.audit_on_end(arriving, f"{tmp_path}/out", f"{tmp_path}/checkpoint", run, parts=3).awaitTermination()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(glob.glob(f"{tmp_path}/out/facts/**/*.parquet", recursive=True)) <= 2 * tasks
    assert len(glob.glob(f"{tmp_path}/out/audited/**/*.parquet", recursive=True)) == crawls
    assert adaptive == ["true"]
    got = {(r.crawl_id, r.url, r.fetch_seq, r.fetched_at) for r in spark.read.parquet(f"{tmp_path}/out/audited").collect()}
    assert got == {r[:4] for r in rows}
