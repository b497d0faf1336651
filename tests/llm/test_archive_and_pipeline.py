"""WARC, decontamination and the pipeline."""

import base64
import gzip
import hashlib
import json

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from quillon.llm import decontaminate, warc
from quillon.llm.registry import QUERIES, SQL
from quillon.session import table

PAGES = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def written(spark, folder, rows, **options):
    files = warc.write_warc(spark.createDataFrame(rows, PAGES), f"file://{folder}", **options)
    return files, warc.read_warc(spark, f"file://{folder}").collect()


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/\r\nx y", "one"), (1, None, "one"), (2, "http://b", None), (5, "http://c", ""), (7, "http://d", "ünï" * 5000), (7, "http://d", "ünï" * 5000), (None, "http://e", "one"), (9, "u", "two\r\n\r\nparts")]
    files, out = written(spark, tmp_path / "w", rows, roll_bytes=500)
    assert len(out) == len(rows) and sum(f["records"] for f in files) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.page_id, []).append(r)
    assert [(r.record_type, r.refers_to, r.payload) for r in by[1]] == [("response", None, b"one")]
    assert [(r.record_type, r.refers_to, r.payload_bytes) for r in by[3] + by[None]] == [("revisit", 1, 3)] * 2
    assert by[2][0].record_type == "response" and by[5][0].refers_to == 2 and by[5][0].payload_digest == digest("")
    assert sorted((r.record_type, r.refers_to) for r in by[7]) == [("response", None), ("revisit", 7)]
    assert by[9][0].payload == b"two\r\n\r\nparts"
    assert by[3][0].url == "http://a/%0D%0Ax%20y"
    assert len({r.record_id for r in out}) == len(out)


def test_warc_small_payloads_are_responses(spark, tmp_path):
    _, out = written(spark, tmp_path / "w", [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long"), (4, "d", "long")], min_revisit_bytes=3)
    assert {r.page_id: r.record_type for r in out} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_warc_is_deterministic_whatever_the_partitions(spark, tmp_path):
    rows = [(i, f"http://{i}", "p" * (i % 50)) for i in range(200)]
    df = spark.createDataFrame(rows, PAGES)
    one = warc.write_warc(df.repartition(7), f"file://{tmp_path}/a", roll_bytes=800)
    two = warc.write_warc(df.coalesce(1).orderBy("html"), f"file://{tmp_path}/b", roll_bytes=800)
    assert one == two and max(f["bytes"] for f in one) < 2000
    for f in one:
        assert (tmp_path / "a" / f["name"]).read_bytes() == (tmp_path / "b" / f["name"]).read_bytes()
        assert hashlib.sha256((tmp_path / "a" / f["name"]).read_bytes()).hexdigest() == f["sha256"]
    assert not (tmp_path / "a" / "_temporary").exists()
    assert json.loads((tmp_path / "a" / "manifest.json").read_text())["files"] == one


def test_warc_shards_of_skewed_ids(spark, tmp_path):
    """One far id, many null and repeated ids: shards stay even, and no record is lost."""
    rows = [(i, "u", f"{i} " * 300) for i in range(600)] + [(10**15, "u", "far")] + [(None, "u", f"nil {i} " * 100) for i in range(200)] + [(77, f"u{i}", f"same id {i} " * 100) for i in range(200)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS shard", "'x' AS sha", "2 AS n")
    files = warc.write_warc(df, f"file://{tmp_path}/w", shard_bytes=20_000)
    by_shard = {}
    for f in files:
        by_shard[f["shard"]] = by_shard.get(f["shard"], 0) + f["records"]
    assert sum(by_shard.values()) == len(rows) and len(by_shard) > 30 and max(by_shard.values()) < 80
    back = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert sorted(r.payload_digest for r in back) == sorted(digest(t) for _, _, t in rows)


def test_warc_very_long_payload_and_repeated_moves(spark, tmp_path):
    text = "long payload " * 400_000
    files, out = written(spark, tmp_path / "w", [(1, "a", text), (2, "b", text), (3, "c", "x")])
    assert {r.page_id: (r.record_type, r.payload_bytes) for r in out} == {1: ("response", len(text)), 2: ("revisit", len(text)), 3: ("response", 1)}
    moved = pd.DataFrame({"temp": ["_temporary/gone"], "name": [files[0]["name"]]})
    assert [list(b["name"]) for b in warc._mover(f"file://{tmp_path}/w")(iter([moved]))] == [[files[0]["name"]]]
    with pytest.raises(FileNotFoundError):
        list(warc._mover(f"file://{tmp_path}/w")(iter([moved.assign(name="never")])))


def test_warc_members_are_standalone_and_checked(spark, tmp_path):
    files, _ = written(spark, tmp_path / "w", [(1, "a", "hello")])
    path = tmp_path / "w" / files[0]["name"]
    text = gzip.decompress(path.read_bytes())
    assert text.count(b"WARC/1.1\r\n") == 2 and b"WARC-Payload-Digest: sha1:" + digest("hello").encode() in text
    path.write_bytes(gzip.compress(text.replace(b"hello", b"hullo")))
    with pytest.raises(Exception, match="damaged record"):
        warc.read_warc(spark, f"file://{tmp_path}/w").collect()


def test_warc_empty(spark, tmp_path):
    files, out = written(spark, tmp_path / "w", [])
    assert files == [] and out == []


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly box with jugs of liquid gold"


def leaks(spark, texts, items=((4, ITEM),)):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS leaks")
    return [r.leaks for r in decontaminate.find_leaks(df, spark.createDataFrame(list(items), "item_id long, text string")).orderBy("doc_id").collect()]


def test_leaks(spark):
    words = ITEM.split()
    swapped = [w if i % 6 != 3 else "other" for i, w in enumerate(words)]
    texts = [None, "", "pad " * 50 + ITEM.upper().replace(" ", ", ") + " pad" * 50, " ".join(swapped), " ".join(words[:14]), " ".join(words[:7]), " ".join(reversed(words)), "pad " * 30_000 + ITEM]
    out = leaks(spark, texts)
    assert [[x.item_id for x in r] for r in out] == [[], [], [4], [4], [4], [], [], [4]]
    assert out[2][0].start == 50 and out[2][0].matches == len(words)


def test_leaks_of_no_benchmark_and_short_items(spark):
    assert leaks(spark, [ITEM], items=[(1, None), (2, ""), (3, "the quick brown")]) == [[]]
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert decontaminate.find_leaks(docs, empty).first().leaks == []
    assert decontaminate.find_leaks(docs.limit(0), empty).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 1)
    other = " ".join(f"word{i}" for i in range(20))
    assert [[x.item_id for x in r] for r in leaks(spark, [other + " " + ITEM, other], items=[(4, ITEM), (2, other)])] == [[2, 4], [2]]


def test_segment_against_brute_force():
    rng = np.random.default_rng(4)
    block = decontaminate.Block([(1, " ".join(f"w{i}" for i in range(25)))])
    for _ in range(200):
        ids = np.where(rng.random(40) < 0.8, np.arange(40) - 6, 0).astype(np.int32)
        found = block.segment(ids, 0, 7)
        same = [i < 25 and ids[i + 7] == block.tokens[0][i] for i in range(25)]
        best = max(((sum(1 if x else -2 for x in same[a:b]), b - a, sum(same[a:b])) for a in range(25) for b in range(a + 1, 26)), key=lambda x: x[:2])
        if found:
            assert found["matches"] - 2 * (found["length"] - found["matches"]) == best[0]
        else:
            assert best[2] < 13 or best[0] < 1 or best[2] < 0.8 * best[1]


def test_decontaminate_query(spark, sf):
    out = {r.doc_id: r for r in decontaminate.op2_decontaminate(spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    items = {r.item_id: decontaminate.tokens(r.text) for r in table(spark, sf, "benchmark").collect()}
    for d in docs:
        words = " " + " ".join(decontaminate.tokens(d.text)) + " "
        whole = {str(i) for i, t in items.items() if " " + " ".join(t) + " " in words}
        assert whole <= set(out[d.doc_id].item_ids.split(",")) and out[d.doc_id].contaminated == (out[d.doc_id].n_items > 0)


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(SQL) <= set(QUERIES)


def test_contract_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in SQL.items():
        relation = con.execute(sql)
        columns = [d[0] for d in relation.description]
        got = QUERIES[name](spark, sf)
        assert sorted(got.columns) == sorted(columns)
        assert sorted(tuple(map(str, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(str, r)) for r in relation.fetchall())


def test_pipeline(spark, sf):
    """Every stage's decisions against the operators' own results, and the whole against run()."""
    docs = table(spark, sf, "documents")
    columns = docs.columns
    seen = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, sf).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        assert 0 < out.count() <= seen.count()
        if k == 3:
            assert decontaminate.find_leaks(out, table(spark, sf, "benchmark")).where("size(leaks) > 0").count() == 0
        seen = out
    final = {r.doc_id: tuple(r.ids) for r in seen.collect()}
    assert {r.doc_id: tuple(r.ids) for r in corpus_pipeline.run(spark, sf).collect()} == final


def test_pipeline_against_brute_force(spark, sf):
    """The stages after the model's scores, in plain Python."""
    from test_dedup_ops import brute_lines
    from test_near_dedup import brute_near
    from tokenizers import Tokenizer

    from quillon.llm.bpe import default_tokenizer
    from quillon.llm.toxicity import contract_model, toxicity

    docs = table(spark, sf, "documents")
    scored = toxicity(docs, contract_model(docs, spark, sf), spans=False).collect()
    rows = brute_lines([(r.doc_id, r.text) for r in scored if r.toxicity.score < 0.5])
    stays = set(brute_near(rows))
    rows = [(i, t) for i, t in rows if i in stays]
    block = decontaminate.Block([(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
    rows = [(i, t) for i, t in rows if not block.hits(t)]
    library = Tokenizer.from_file(default_tokenizer())
    want = {i: tuple(library.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert {r.doc_id: tuple(r.ids) for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_pipeline_edges(spark, sf):
    rows = [(1, None), (2, ""), (None, "hello there my friend"), (4, "hello there my friend"), (4, "hello there my friend")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = stage(spark, docs, sf).cache()
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [1, 4]
