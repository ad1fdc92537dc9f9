"""The pipeline's stages against what they promise, on a small table."""

import collections
import zlib

import brute
import duckdb
import numpy as np
import pandas as pd

import corpus_pipeline as cp
from marlstone.llm import queries, tokens


def corpus(spark, tmp_path):
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(3, 9))) for _ in range(400)]
    common = "the of and to in a is that for it was on are as with".split()

    def line():
        return " ".join(rng.choice(common if k % 2 else plain) for k in range(14)).capitalize() + "."

    rows = [(i, "\n".join(line() for _ in range(5)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[0][1], "en", "s0", 1) for i in range(5)] + [(200, "zz### " * 40, "en", "s1", 1), (201, None, "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == cp.COLUMNS
    assert not {200, 201} & set(seen["quality rules"].doc_id) and {r[0] for r in rows[:60]} <= set(seen["quality rules"].doc_id)
    lines = seen["line dedup"].set_index("doc_id")
    assert lines.loc[0, "text"] == rows[0][1] and (lines.loc[100:104, "text"] == "").all()
    assert (lines.n_chars == lines.text.str.len()).all()
    near = seen["near dedup"]
    assert near.doc_id.is_unique and {0} <= set(near.doc_id) and len(set(near.doc_id) & set(range(100, 105))) <= 1
    words = near.set_index("doc_id").text.str.split().str.len()
    assert seen["mixing"].text.str.split().str.len().sum() >= 1.4 * words.sum()
    pieces = seen["packing"]
    assert pieces.length.sum() >= len(seen["mixing"]) and pieces.groupby("sequence_id").length.sum().max() <= 1024
    whole = cp.run(spark, str(tmp_path)).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32"]
    pd.testing.assert_frame_equal(whole[key].sort_values(key).reset_index(drop=True), pieces[key].sort_values(key).reset_index(drop=True))


AWKWARD = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \t\n", "en", "a", 3), (None, "two words", "en", "b", 9), (None, "two words", "en", "b", 9), (None, "others alone", "de", None, 5), (7, "same id", "en", "a", 7), (7, "another text altogether", "en", "a", 7), (7, "same id", "en", "a", 7), (9, "x" * 50_000, "en", "a", 1), (10, "word " * 30_000, "en", "a", 1)]


def awkward(spark, rows):
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    return d.selectExpr("*", "1 as kept", "2 as size", "3 as taken", "4 as `row`", "5 as own", "6 as mark", "7 as one", "8 as gone")


def test_stages_over_awkward_rows(spark, tmp_path):
    docs = awkward(spark, AWKWARD)
    rules = cp.quality_rules(spark, docs, "").toPandas()
    assert list(rules.columns) == cp.COLUMNS and len(rules) == 0
    lines = cp.line_dedup(spark, docs, "").toPandas()
    assert len(lines) == len(AWKWARD) and lines.doc_id.isna().sum() == 3 and lines.text.isna().sum() == 1
    near = cp.near_dedup(spark, docs, "").toPandas()
    # null, empty and blank texts are one group; a repeated row stays once; rows without an id stay once a group
    assert sorted(near.text.fillna("").str[:10]) == sorted(["", "two words", "others alo", "same id", "another te", "x" * 10, "word word "])
    assert near[near.text.isna()].doc_id.tolist() == [1]
    mixed = cp.mix_sources(spark, docs, "").toPandas()
    size = mixed.text.str.split().str.len()
    assert list(mixed.columns) == cp.COLUMNS and (size > 0).all() and {"two words", "others alone"} <= set(mixed.text[mixed.doc_id.isna()])
    total = sum(len((t or "").split()) for _, t, *_ in AWKWARD)
    assert abs(size.sum() - 1.5 * total) < 0.1 * total
    pieces = cp.pack_sequences(spark, docs, "").toPandas()
    assert (pieces.start == 0).sum() == len(AWKWARD)


def test_stages_over_an_empty_table(spark):
    docs = awkward(spark, AWKWARD).limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_each_stage_is_its_plain_version(spark, tmp_path):
    """Rows of every stage against SQL or a loop over its own input; what comes out at last against the tokenizer."""
    rng = np.random.default_rng(17)
    plain = ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(3, 9))) for _ in range(700)]
    common = "the of and to in a is that for it was on are as with by be or".split()

    def line(n):
        return " ".join(str(rng.choice(common if rng.random() < 0.5 else plain)) for _ in range(n))

    kept = [line(int(rng.integers(9, 30))) for _ in range(12)]
    rows = []
    for i in range(70):
        lines = [line(int(rng.integers(9, 30))) for _ in range(rng.integers(3, 9))]
        if rng.random() < 0.4:
            w = str(rng.choice(kept)).split()
            w[rng.integers(1, len(w))] = "changed"
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines), "en", None if i % 9 == 0 else f"s{i % 4}", 1))
    rows += [(200 + i, rows[i][1], "en", "s0", 1) for i in range(8)] + [(300, "zz### " * 60, "en", "s1", 1), (301, None, "en", "s1", 1), (302, "short", "en", "s1", 1), (None, rows[20][1] + "\n" + line(20), "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/raw")
    next(tmp_path.glob("raw/*.parquet")).rename(tmp_path / "documents.parquet")
    docs, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = [tuple(r) for r in docs.select(*docs.columns[:4]).collect()] if name != "packing" else docs.toPandas()
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    good = {None if pd.isna(i) else int(i) for i in db.execute(f"select doc_id from ({queries.ORACLES['op3_quality_rules']}) where kept").df().doc_id}
    by = lambda rs: sorted((str(r[0]), r[1]) for r in rs)
    first = out["quality rules"]
    assert by(first) == by(r for r in rows if r[0] in good) and {300, 301, 302}.isdisjoint(good) and len(good) > 70
    want = brute.lines([(10**9 if i is None else i, t) for i, t, *_ in first])
    assert by((None if i == 10**9 else i, t) for i, t in want.items()) == by(out["line dedup"]) and by(first) != by(out["line dedup"])
    groups = collections.defaultdict(list)
    for (i, t, *_), (_, f, c) in zip(out["line dedup"], brute.components([r[:2] for r in out["line dedup"]]), strict=True):
        groups[c if c is not None else f].append((i is None, i or 0, t))
    assert by((None if n else i, t) for n, i, t in (min(g) for g in groups.values())) == by(out["near dedup"])
    taken = brute.mix(spark, [(i, t, s) for i, t, _, s in out["near dedup"]])
    texts = []
    for (i, t), parts in taken.items():
        w = t.split()
        for n in parts:
            texts += [(i, t)] * (n // len(w) if w else 0) + ([(i, " ".join(w[: n % len(w)]))] if w and n % len(w) else [])
    assert by(texts) == by(out["mixing"])
    pieces = out["packing"]
    whole = collections.Counter()
    for _, t, *_ in out["mixing"]:
        ids = np.append(tokens.token_ids(t), 0).astype("<u4")
        whole.update((at, min(1024, len(ids) - at), zlib.crc32(ids[at : at + 1024].tobytes())) for at in range(0, len(ids), 1024))
    assert whole == collections.Counter(zip(pieces.start, pieces.length, pieces.ids_crc32, strict=True))
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024
