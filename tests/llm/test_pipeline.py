"""The pipeline's stages, each against plain Python on its own input."""

import random

import corpus_pipeline
from crawlens.llm import toxicity
from crawlens.llm.common import table
from test_dedup import SCHEMA, lowered, plain_shingles, plain_similarity
from test_forms import TOKENIZER, check_pieces
from test_near import plain_kept
from tokenizers import Tokenizer


def test_stages_in_turn(spark, tmp_path):
    from collections import Counter

    r = random.Random(3)
    words = ["the", "you", "house", "Garden", "walk", "tree.", "river", "and", "of", "stone", "cloud", "sand"]
    item = " ".join(r.choice(words) + str(i) for i in range(40))
    rows, labels = [], []
    for i in range(400):
        own = [r.choice(words) + r.choice(["", "s", "ly"]) for _ in range(r.randint(10, 300))]
        if i % 6 == 0:
            own[r.randrange(len(own))] = own[0] = "dimwit"
        if i % 11 == 0:
            own[5:5] = item.split()
        rows.append((i, " ".join(own), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    for i in range(400, 450):
        rows.append((i, rows[i - 400][1].upper() if i % 2 else rows[i - 400][1], "en", "s0", 1))
    for i in range(450, 490):  # near copies, on either side of 0.8
        own = rows[i - 450][1].split()
        for _ in range(1 + len(own) * (i % 3) // 60):
            own[r.randrange(len(own))] = "edited"
        rows.append((i, " ".join(own), "en", "s2", 1))
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), (502, "", "en", "s1", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, str(tmp_path), "documents")
    given, stages = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), name)
        stages[name] = (docs.collect(), out.collect())
        if name != "packing":
            assert out.columns == given.columns
        docs = out
    before, after = stages["toxicity"]
    scored = {x.doc_id: x.predicted for x in toxicity.score_documents(given, toxicity.fit(given, table(spark, str(tmp_path), "labels"))).collect()}
    assert {x.doc_id for x in after} == {x.doc_id for x in before if not scored[x.doc_id]}
    assert sum(x.doc_id < 400 and x.doc_id % 6 == 0 for x in after) < 5 and sum(x.doc_id % 6 > 0 for x in after if x.doc_id < 400) > 320
    before, after = stages["exact_dedup"]
    top = {}
    for x in before:
        top[lowered(x.text)] = max(top.get(lowered(x.text), -1), x.doc_id)
    assert sorted(x.doc_id for x in after) == sorted(top.values())
    before, after = stages["near_dedup"]
    kept, n = plain_kept([(x.doc_id, x.text) for x in before])
    assert n >= 15 and {x.doc_id for x in after} == kept and len(after) == len(kept)
    before, after = stages["decontamination"]
    whole = Counter(plain_shingles(item))
    size = sum(whole.values())
    dirty = set()
    for x in before:
        own = plain_shingles(x.text)
        if own and max(plain_similarity(Counter(own[a : a + size]), whole) for a in range(max(1, len(own) - size + 1))) >= 0.8:
            dirty.add(x.doc_id)
    assert dirty and {x.doc_id for x in after} == {x.doc_id for x in before} - dirty
    before, after = stages["packing"]
    made = Tokenizer.from_file(TOKENIZER)
    made.encode_special_tokens = True
    check_pieces(after, [(x.doc_id, x.text, x.source) for x in before], made)
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "ids_crc32").collect())) == sorted(repr(x) for x in docs.select("doc_id", "start", "ids_crc32").collect())
