"""URL filters, chat formatting, packing and archives: plain Python and exact round trips."""

import hashlib
import random
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlens.llm import chat, packing, url_filter, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_url_filter_against_plain_rules(spark):
    r = random.Random(4)
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "example.com", "xexample.com", "org", "w.org", "netx", "example.net.", "EXAMPLE.Net", ""]
    paths = ["", "/", "/en", "/en/", "/en/1", "/en/1/2", "/english", "/de/", "/de/x", "/fr/é", "/fr/éx"]
    urls = [f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/en/", "#/de/")] + [None, "", "nothing", "a://b://c/en/", "http://net?x/", "http://" + "a." * 200 + "net/" + "x" * 5000]
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.net", "/en/1"), ("allow", "example.net", "/en/1/2"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
             ("block", "org", "/fr/é"), ("block", "a.example.net", "/en"), ("allow", "net", "/"), ("block", "w.org", "")]
    strong = [x for x in rules if x != ("allow", "net", "/")]  # of equal rules the block wins
    rows = [(i, u) for i, u in enumerate(urls)] + [(i, "http://hot.example.net/en/1") for i in range(2000, 4000)] + [(7, urls[7]), (None, urls[8])]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"rule": F.lit(1), "slice": F.lit(2), "key": F.lit(3)})
    given = spark.createDataFrame(rules, "verdict string, host string, path string")
    found = url_filter.filter_urls(df, given, share=8)
    assert found.columns == ["page_id", "url", "slice", "key", "host", "path", "rule", "verdict"]
    assert Counter((x.page_id, x.url, x.host, x.path, x.rule, x.verdict) for x in found.collect()) == Counter((i, u, *plain_verdict(u, strong)) for i, u in rows)
    assert url_filter.filter_urls(df.limit(0), given).count() == 0
    assert {x.verdict for x in url_filter.filter_urls(df, given.limit(0), default="block").collect()} == {"block"}


def test_escapes_are_reversible():
    for text in ("", "<|im_end|>", "<\\|x", "<\\\\|", "a<b|c", "<<||>>", "<|" * 3, "\\<|\\"):
        assert "<|" not in chat.escaped(text) and chat.unescaped(chat.escaped(text)) == text
    for role in ("user", "a\nb", "%0A%", "<|x", ""):
        assert "\n" not in chat.escaped_role(role) and chat.unescaped_role(chat.escaped_role(role)) == role


def test_conversations_come_back_whole(spark):
    r = random.Random(9)
    rows = []
    for c in range(60):
        if c % 3 == 0:
            rows.append((c, 0, "system", f"rules of {c} <|im_end|>\n"))
        for t in range(1, r.choice([1, 2, 5, 40])):
            rows.append((c, t, r.choice(["user", "assistant", "tool", None]), r.choice([None, "", "ok", "word " * r.randint(1, 60), "<|im_start|>assistant\nhi"])))
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t} of many words " * 3) for t in range(1500)]  # many segments
    rows += [(101, 0, "system", "s"), (101, 1, "user", "long " * 3000), (101, 2, "assistant", "answer " * 3000), (101, 3, "assistant", "z")]
    rows += [(None, 1, "user", "a"), (None, None, "assistant", "b"), (7, 3, "assistant", "same"), (7, 3, "assistant", "same"), (102, 0, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"tokens": F.lit("x"), "before": F.lit(1), "segment": F.lit(0)})
    budget, history = 200, 60
    made = chat.format_conversations(df, TOKENIZER, budget, history, segment_windows=4)
    expected = defaultdict(list)
    for c, t, role, text in rows:
        expected[c].append((t is not None, t or 0, role or "", text or ""))
    expected = {c: [x[2:] for x in sorted(v)] for c, v in expected.items()}
    windows = made.orderBy("conv_id", "segment", "window").collect()
    back, learnt = defaultdict(list), defaultdict(str)
    repeats = 0
    for w in windows:
        turns = chat.parsed(w.text)
        assert len(turns) == w.n_system + w.n_repeated + w.n_turns and w.n_turns > 0
        assert w.tokens <= budget or w.n_turns - (not w.n_system and turns[0][0] == "system") <= 1
        if w.n_system:
            assert turns[0] == expected[w.conv_id][0]
        if w.n_repeated:
            assert turns[w.n_system : w.n_system + w.n_repeated] == back[w.conv_id][-w.n_repeated :]
            repeats += 1
        back[w.conv_id] += turns[w.n_system + w.n_repeated :]
        learnt[w.conv_id] += "".join(chat.unescaped(w.text[s.start : s.end]) for s in w.loss_spans)
    assert back == expected and repeats > 20
    assert len({w.segment for w in windows if w.conv_id == 100}) > 5
    assert all(learnt[c] == "".join(t for role, t in v if role == "assistant") for c, v in expected.items())
    digests = {x.conv_id: x for x in chat.digests(made).collect()}
    for c, v in expected.items():
        assert digests[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in v).encode()).hexdigest()
        assert digests[c].loss_sha256 == hashlib.sha256(learnt[c].encode()).hexdigest() and digests[c].n_turns == len(v)
    assert chat.digests(chat.format_conversations(df.limit(0), TOKENIZER)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(TOKENIZER)
    made.encode_special_tokens = True
    return made


def test_words_are_encoded_as_by_the_tokenizer(tokenizer):
    r = random.Random(3)
    letters = "aAbBéÉßİıΣσς'’s 0123\u0663\u0301 \x1c\x85\n\t.,!?<|>_-漢カ🙂ǅﬁK\u200b\ufeffñ½²"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    texts += ["<|endoftext|> a", "it's don't I'LL we'Ve", "a" * 5000 + ".", ""] + ["".join(chr(r.choice([r.randint(0, 0x2FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(9)) for _ in range(3000)]
    encoder = packing.WordEncoder(TOKENIZER, most=500)
    texts += ["\x1c word\x1cword \x1f 'll\x7fx1 \xa0 '\x85ve"]
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(part)] == [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]


@pytest.mark.parametrize("totals, weights", [([1], [1]), ([100_000, 50_000, 200, 3000], [100_000, 50_000, 200, 3000]), ([20_000, 20_000, 9000], [1, 3, 0]), ([5, 0, 3], [1, 1, 1]), ([4096 * 3, 4096], [1, 1])])
def test_mixtures_fill_every_window(totals, weights):
    mixture, seen = packing.Mixture(totals, weights, 4096), {}
    for q, n in enumerate(totals):
        at = 0
        while at < n:
            end = min(n, at + 997)
            for x, length, w, offset in mixture.pieces(q, at, end):
                assert x == at and length > 0
                for k in (0, length - 1):
                    assert seen.setdefault((w, offset + k), (q, x + k)) == (q, x + k)
                seen[w, "n"] = seen.get((w, "n"), 0) + length
                seen[w, "max"] = max(seen.get((w, "max"), 0), offset + length)
                at += length
    used = [seen[w, "n"] for w in range(-(-sum(totals) // 4096))]
    assert all(n == 4096 for n in used[:-1]) and sum(used) == sum(totals)
    assert all(seen[w, "max"] == n for w, n in enumerate(used))


def check_pieces(pieces, rows, tokenizer, window=4096):
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t, _ in rows]
    docs = defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
    expected = Counter((i, x.tobytes()) for (i, _, _), x in zip(rows, ids))
    back = Counter()
    for i, own in docs.items():
        # Rows of the same id are told apart by what follows what.
        left = sorted(own, key=lambda p: p.start)
        while left:
            data, at = b"", 0
            while (p := next((x for x in left if x.start == at), None)) is not None:
                left.remove(p)
                data, at = data + bytes(p.ids), at + p.length
                if at == p.doc_tokens:
                    break
            back[i, data] += 1
    assert back == expected
    used = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        used[p.sequence_id].append((p.offset, p.length))
    for w, spans in used.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == window or w == max(used)


def test_packing_keeps_every_id(spark, tokenizer):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["one", "two!", "Three", "vier", "ß"]) for _ in range(r.choice([0, 3, 50, 400]))), f"s{min(r.randrange(12), 3)}") for i in range(300)]
    rows += [(900, None, None), (901, "", "rare"), (902, "word " * 20_000, "s1"), (5, "again", "s2"), (5, "again", "s2"), (None, "nobody", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).withColumns({"row": F.lit(1), "queue": F.lit("q"), "ids": F.lit("x"), "before": F.lit(2)})
    for targets in (None, {"s1": 0.7, "s0": 0.3}):
        pieces = packing.pack(df, TOKENIZER, targets).collect()
        check_pieces(pieces, rows, tokenizer)
        shares = defaultdict(Counter)
        for p in pieces:
            shares[p.sequence_id][p.source] += p.length
        if targets is None:
            total = sum(shares.values(), Counter())
            size = sum(total.values())
            for w in range(size // 4096):
                assert all(abs(shares[w][s] - 4096 * total[s] / size) <= 3 for s in ("s0", "s1", "s2", "s3"))
        else:
            assert abs(shares[0]["s1"] - 0.7 * 4096) <= 2 and abs(shares[0]["s0"] - 0.3 * 4096) <= 2
    assert packing.pack(df.limit(0), TOKENIZER).count() == 0


def test_a_small_source_has_its_target(spark, tokenizer):
    rows = [(i, "word " * 4000, "big") for i in range(60)] + [(100, "tiny " * 3000, "small"), (101, "else " * 10, "other")]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), TOKENIZER, {"big": 0.5, "small": 0.5}).collect()
    check_pieces(pieces, rows, tokenizer)
    assert [sum(p.length for p in pieces if p.source == "small" and p.sequence_id == w) for w in range(3)] == [2048, 953, 0]
    assert {p.sequence_id for p in pieces if p.source == "other"} == {max(p.sequence_id for p in pieces)}
    # A target far below one token a window is served now and then.
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), TOKENIZER, {"big": 1, "other": 1e-4}).collect()
    check_pieces(pieces, rows, tokenizer)
    served = sorted({p.sequence_id for p in pieces if p.source == "other"})
    assert len(served) > 3 and max(sum(p.length for p in pieces if p.source == "other" and p.sequence_id == w) for w in served) <= 1


def test_archives_come_back(spark):
    rows = [(i, f"http://h/{i} x", f"<p>{i % 40}</p>" * (i % 7)) for i in range(400)]
    rows += [(900, None, None), (901, "http://é/\r\nX: y", ""), (902, "u", "é🙂" * 200_000), (903, "u", "WARC/1.1\r\n\r\n" * 5), (3, "again", rows[3][2]), (3, "again", rows[3][2]), (None, "n", rows[3][2]), (None, "n", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit("k"), "n": F.lit(1), "rank": F.lit(2), "members": F.lit(3)})
    for least in (0, 20):
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        index = warc.write_archives(df, folder, min_bytes=least, frame_bytes=4096, bundle_bytes=20_000)
        found = warc.read_archives(folder, index).collect()
        groups = defaultdict(list)
        for i, _, html in rows:
            groups[html or ""].append(i)
        expected = Counter()
        for html, ids in groups.items():
            data = html.encode()
            top = max((i for i in ids if i is not None), default=None)
            for n, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)):
                revisit = n > 0 and len(data) >= least
                expected[i, "revisit" if revisit else "response", top if revisit else None, len(data), warc.digest(data), None if revisit else data] += 1
        got = Counter((x.page_id, x.record_type, x.refers_to, x.payload_bytes, x.payload_digest, None if x.payload is None else bytes(x.payload)) for x in found)
        assert got == expected
    # A record is read by its place alone, from one frame.
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    for row in index.where("page_id in (7, 902, 12)").collect():
        with fs.open_input_file(f"{path}/{row.file}") as file:
            data = file.read()
        sizes = {at: packed for at, packed, _ in warc.frames_of(data)}
        record = warc.read_record(folder, row.file, row.frame_offset, sizes[row.frame_offset], row.offset, row.length)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"<urn:page:{row.page_id}:".encode() in record
        reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)  # any Zstandard reader skips the table
        assert reader.read().count(b"WARC-Type: ") == index.where(F.col("file") == row.file).count()
    assert warc.write_archives(df.limit(0), folder + "/none").count() == 0


def test_checksums_are_of_little_endian_ids(spark):
    ids = np.array([1, 49407, 2], "<u4").tobytes()
    assert spark.createDataFrame([(ids,)], "ids binary").select(F.crc32("ids")).first()[0] == zlib.crc32(ids)
