"""Operators against brute force, on small tables with awkward rows."""

import collections
import dataclasses
import itertools
import math
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from marlstone.llm import classifier, html_text, html_training, lines, mixing, packing, pseudo_lm, quality, queries, simhash, tokens, topk, unigram

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SIMPLE = settings(max_examples=60, deadline=None)


# op1
@SIMPLE
@given(st.text(alphabet="ab ▁é日🙂\n.,xyz<0>", max_size=80))
def test_counts_match_the_library(text):
    c = unigram.counter(unigram.vocabulary_path(unigram.VOCABULARY))
    assert c.text(text)[0] == len(unigram.model().encode(text, add_special_tokens=False).ids)


def test_control_pieces_are_no_text():
    c = unigram.counter(unigram.vocabulary_path(unigram.VOCABULARY))
    for text in ("<s>", "</s> a", "<unk>", "a<s>b", "x" * 3000, "日本" * 2000):
        assert c.text(text)[0] == len(unigram.model().encode(text, add_special_tokens=False).ids)
        assert text.startswith("x") or c.text(text)[0] > 1


def brute_unigram(c, pieces, word):
    """Best score over all splits into pieces and unknown characters."""
    best = [0.0] + [-math.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 20), end):
            s = pieces.get(word[start:end], c.unknown if end - start == 1 else -math.inf)
            best[end] = max(best[end], best[start] + s)
    return best[-1]


@SIMPLE
@given(st.text(alphabet="abcdetn sz日é", min_size=1, max_size=30))
def test_scores_are_the_best_of_all_splits(text):
    path = unigram.vocabulary_path(unigram.VOCABULARY)
    c, pieces = unigram.counter(path), dict(unigram.vocabulary(path))
    words = ("▁" + text.replace(" ", " ▁")).split(" ")
    want = sum(brute_unigram(c, pieces, w) for w in words)
    assert text.startswith(" ") or np.isclose(c.text(text)[1], want)


def test_token_counts_awkward(awkward):
    got = unigram.token_counts(awkward).toPandas()
    assert len(got) == 9 and (got[got.doc_id.isin([1, 2])].n_tokens == 0).all() and (got[got.doc_id == 4].n_tokens > 0).all()
    assert unigram.token_counts(awkward.limit(0)).count() == 0


# op2
def near(rng, n=300):
    base = rng.integers(0, 2**63, n // 6, dtype=np.uint64)
    out = list(base)
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.integers(1, 4)):
            x ^= np.uint64(1) << np.uint64(rng.integers(64))
        out.append(x)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("seed", range(5))
def test_gray_index_finds_all(seed):
    codes = near(np.random.default_rng(seed))
    q, o = simhash.GrayIndex(codes).within(codes)
    want = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    assert set(zip(q, o, strict=True)) == set(zip(*np.nonzero(want), strict=True))


@pytest.mark.parametrize("group", [4096, 2])
def test_links_join_what_brute_force_joins(spark, group):
    codes = near(np.random.default_rng(9), 200)
    codes = np.unique(np.r_[codes, [(1 << 20) ^ (a << 3) for a in range(40)]].astype(np.uint64))  # one hot pattern
    df = spark.createDataFrame(pd.DataFrame({"fp": codes.view(np.int64), "rep": np.arange(len(codes))}))
    got = {r["u"]: r["v"] for r in simhash.components(simhash.links(df, group)).collect()}
    a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2)
    want = simhash._union(np.arange(len(codes)), a, b)
    assert [got.get(i, i) for i in range(len(codes))] == want.tolist()


def test_fingerprint_is_the_majority():
    import xxhash

    text = "A b C d e a B c"
    w = [x.lower() for x in WORDS.findall(text)]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("one TWO") == xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_near_duplicates_awkward(awkward):
    got = simhash.near_duplicates(awkward).toPandas()
    assert len(got) == 9
    by = got.set_index(got.doc_id.fillna(-1).astype(int))
    assert (by.loc[[1, 2, 3], "component_id"] == 1).all() and (by.loc[[1, 2, 3], "fingerprint"] == "0" * 16).all()
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("small", [200_000, 0])
def test_near_duplicates_agree_with_brute_force(docs, small):
    rng = np.random.default_rng(11)
    base = [" ".join("".join(rng.choice(list("abcdef"), 4)) for _ in range(400)) for _ in range(12)]
    rows = []
    for i in range(240):
        w = base[i % 12].split()
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(len(w))] = "zz"
        rows.append((None if i % 4 == 0 else 1000 - i, " ".join(w)))
    w = base[0].split()[::-1]
    for i in range(40):  # a chain of small changes; most links run through rows without an id
        rows.append((2000 + i if i % 6 == 0 else None, " ".join(w)))
        w[i * 9] = "yy"
    rows += [(None, None), (None, "alone without an id"), (None, "alone without an id"), (5, "alone"), (6, "alone"), (6, "alone")]
    got = simhash.near_duplicates(docs([(i, t, "s") for i, t in rows]), small=small)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()), key=key)
    want = sorted(brute.components(rows), key=key)
    assert got == want
    # some links run only through rows without an id
    with_id = [(i, t) for i, t in rows if i is not None]
    alone = {i: c for i, _, c in brute.components(with_id)}
    assert any(alone[i] != c for i, _, c in want if i is not None)


# op3
def brute_repeats(w, n=8):
    seen = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return len({j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)})


def test_base_rules(docs):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(40)] + ["a b c d e f g h " * 9, "x\nx\n\n \nx\ny #*$", None, ""]
    got = quality.quality(docs([(i, t, "s") for i, t in enumerate(texts)])).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        w = WORDS.findall(t or "")
        full = [x for x in (t or "").split("\n") if WORDS.search(x)]
        want = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)), brute_repeats(w)
        assert tuple(got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want
        assert got.loc[i, "base_failed"] == (len(w) < 20 or 100 * want[4] > 30 * len(w))
        assert not (got.loc[i, "base_failed"] and got.loc[i, "kept"])


def matches_sql(spark, tmp_path, name, table, rows):
    """The query over a folder with one table, and its SQL in DuckDB: whole results."""
    import duckdb

    rows.coalesce(1).write.parquet(f"{tmp_path}/raw")
    next(tmp_path.glob("raw/*.parquet")).rename(tmp_path / f"{table}.parquet")
    db = duckdb.connect()
    db.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    want, got = db.execute(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and len(want) == len(got)
    key = lambda df: sorted(tuple("" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].astype({"doc_id": float} if "doc_id" in df else {}).itertuples(index=False))
    assert key(want) == key(got)
    return got


def prose(rng, vocabulary, n):
    common = "the of and to in a is that it for was on with as be by".split()
    w = [str(rng.choice(common if rng.random() < 0.45 else vocabulary)) for _ in range(n)]
    return " ".join(x.capitalize() + "," * (i % 11 == 0) + "." * (i % 9 == 8) for i, x in enumerate(w))


def test_divergence_rejects_junk_and_keeps_prose(spark, docs, tmp_path):
    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(3, 9))) for _ in range(900)]
    rows = [(i, prose(rng, vocabulary, int(rng.integers(80, 300))), "s") for i in range(120)]
    junk = [(200, " ".join(f"{x}{'*' * 3}" for x in rng.choice(vocabulary, 90)), "s"), (201, " ".join(rng.choice(vocabulary, 120)).upper(), "s"), (202, " ".join(x for x in rng.choice(vocabulary, 40) for _ in range(4)), "s")]
    got = quality.quality(docs(rows + junk)).toPandas().set_index("doc_id").sort_index()
    assert got.loc[:119, "kept"].all() and not got.loc[200:, "kept"].any() and not got.loc[200:, "base_failed"].any()
    odd = [(300, None, "s"), (301, "", "s"), (301, "", "s"), (None, rows[0][1], "s"), (302, "ß É 日本 🙂 x\ny\n\ny", "s")]
    many = docs(rows + junk + odd).withColumn("lang", F.expr("case when doc_id % 50 = 3 then 'rare' when doc_id % 7 = 1 then null when doc_id % 7 = 2 then 'de' else lang end"))
    matches_sql(spark, tmp_path, "op3_quality_rules", "documents", many)


def test_common_words_are_learned(docs):
    rows = [(i, "Alpha beta, " * 50 + f"own{i} " * 3, "s") for i in range(30)]
    found = quality.common_words(docs(rows).withColumn("lang", F.expr("if(doc_id < 20, 'xx', null)")), "text", "lang", quality.Rules())
    assert set(found) == {"xx", "other"} and {"alpha", "beta"} <= set(found["xx"]) and abs(found["xx"]["alpha"] - 50 / 103) < 1e-9


def test_quality_awkward(awkward):
    got = quality.quality(awkward, carry=True).toPandas()
    assert len(got) == 9 and not got[got.doc_id < 5].kept.any() and got.row.map(lambda r: r["kept"]).eq(3).all()
    assert quality.quality(awkward.limit(0)).count() == 0 and quality.quality(awkward.drop("lang")).count() == 9


# op4
@SIMPLE
@given(st.lists(st.sampled_from([chr(i) for i in range(0x250)] * 2 + list("   \n\n''sdlret") * 40 + ["日", "🙂", "<|endoftext|>"] * 3), max_size=120).map("".join))
def test_token_ids_are_the_librarys(text):
    want = tokens._exact(tokens.vocabulary_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert tokens.token_ids(text).tolist() == want


def test_both_libraries_agree_on_every_pair_of_characters():
    plain = [chr(i) for i in range(0x250)]
    exact = tokens._exact(tokens.vocabulary_path("byte_bpe_50k.json"))
    for c in plain:
        text = "".join(f"{c}{d}x {c}{d} " for d in plain)
        assert tokens.token_ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["x" * 300_000, " " * 300_000, "\n" * 50_000 + "a", "ab " * 100_000, "é" * 5000, "a\u00a0" * 5000, "1" * 20_000])
def test_very_long_runs(text):
    want = tokens._exact(tokens.vocabulary_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert tokens.token_ids(text).tolist() == want


@SIMPLE
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_patterns_place_everything_once(counts):
    x = np.zeros(65, np.int64)
    x[list(counts)] = list(counts.values())
    made = packing.patterns(x, 64)
    assert (sum((k * p for k, p in made), np.zeros(65, np.int64)) == x).all()
    assert all(0 < p @ np.arange(65) <= 64 for _, p in made)


def test_packing_round_trip(docs):
    texts = ["lorem ipsum dolor " * k for k in (1, 3, 50, 400, 700)] * 6 + [None, "", "é日"]
    got = packing.pack(docs([(i, t, "s") for i, t in enumerate(texts)])).toPandas()
    for i, t in enumerate(texts):
        ids = np.append(tokens.token_ids(t), 0).astype("<u4")
        mine, at = got[got.doc_id == i].sort_values("start"), 0
        for r in mine.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024
    assert got.sequence_id.nunique() * 1024 < 1.1 * got.length.sum() + 1024


def test_sequences_hold_the_texts(docs):
    texts = {i: t for i, t in enumerate(["lorem ipsum " * k for k in (1, 9, 80, 900)] * 3 + ["é日 x", ""])}
    pieces = packing.pack(docs([(i, t, "s") for i, t in texts.items()]), ids=True)
    rows = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(pieces, pad=7).collect()}
    assert all(len(x) == 1024 for x in rows.values())
    parts = collections.defaultdict(list)
    for r in pieces.collect():
        assert bytes(r["ids"]) == rows[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tobytes() and zlib.crc32(r["ids"]) == r["ids_crc32"]
        parts[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    for i, t in texts.items():
        assert b"".join(x for _, x in sorted(parts[i])) == np.append(tokens.token_ids(t), 0).astype("<u4").tobytes()
    assert sum((x[n:] == 7).all() for x, n in ((rows[r["sequence_id"]], r["n_ids"]) for r in packing.sequences(pieces, pad=7).collect())) == len(rows)


def test_packing_awkward(awkward):
    assert packing.pack(awkward).where("doc_id = 4").count() == 2
    assert packing.pack(awkward.limit(0)).count() == 0


# op5
def test_recurring_lines_stay_in_the_first_document(docs):
    line = "this is page 7 of the long report here"
    rows = [(3, f"own line of three\n{line}\n{line}", "s"), (1, line.replace("7", "8"), "s"), (2, f"{line}\nrest 1", "s"), (9, None, "s"), (8, "", "s")]
    rows += [(20 + i, f"All rights reserved.\nunique{chr(97 + i)} words stand here", "s") for i in range(21)]
    got = lines.drop_recurring_lines(docs(rows)).toPandas().set_index("doc_id")
    assert got.loc[1, "text"] == line.replace("7", "8") and got.loc[2, "text"] == "rest 1"
    assert got.loc[3, "text"] == "own line of three" and got.loc[3, "n_dropped"] == 2
    assert got.loc[9, "text"] is None and got.loc[8, "text"] == "" and got.loc[8, "n_lines"] == 1
    assert got.loc[20, "n_dropped"] == 0 and (got.loc[21:40, "n_dropped"] == 1).all()


def test_lines_that_differ_by_a_word_meet(docs):
    names = ["alice", "bob", "carol", "dave", "erin", "frank", "grace", "heidi", "ivan", "judy", "kim", "leo", "mia", "ned", "olga", "pat", "quin", "rose", "sam", "tess", "uma", "vic"]
    long = "please send the {} report to the office in {} before the end of the week"
    rows = [(i, f"user {n} logged in\nown line of {n} alone here", "s") for i, n in enumerate(names)]
    rows += [(100, long.format("annual", "paris") + "\nfirst", "s"), (101, long.format("monthly", "rome") + "\nsecond", "s"), (102, "please send no letters to any house in berlin after the start of this month", "s")]
    got = lines.drop_recurring_lines(docs(rows)).toPandas().set_index("doc_id").sort_index()
    assert got.loc[0, "n_dropped"] == 0 or got.loc[0, "text"].startswith("user")
    assert all(not got.loc[i, "text"].startswith("user") for i in range(1, len(names)))
    assert got.loc[100, "n_dropped"] == 0 and got.loc[101, "text"] == "second" and got.loc[102, "n_dropped"] == 0


@pytest.mark.parametrize("small", [200_000, 0])
def test_template_tree_agrees_with_brute_force(docs, small):
    rng = np.random.default_rng(8)
    vocabulary = ["w" + "".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    bases = [list(rng.choice(vocabulary, int(rng.integers(9, 40)))) for _ in range(60)]

    def variant():
        w = list(bases[rng.integers(len(bases))]) if rng.random() < 0.5 else list(rng.choice(vocabulary, int(rng.integers(9, 40))))
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(1, len(w))] = str(rng.choice(vocabulary))
        return " ".join(w)

    rows = [(i, "\n".join(variant() for _ in range(rng.integers(1, 7)))) for i in range(70)]
    got = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(docs([(i, t, "s") for i, t in rows]), small=small).collect()}
    assert got == brute.lines(rows) and sum(got[i] != t for i, t in rows) > 20


@pytest.mark.parametrize("small", [200_000, 0])
def test_alike_lines_meet_in_large_bands(docs, small):
    """Pairs that share one band only, with all others of a leaf too."""
    one = [f"the same start {' '.join(f'{chr(97 + k)}{w}' for w in 'abcdef')}".split() for k in range(20)]
    two = [[*w[:3], "other", *w[4:8], "end"] for w in one]  # two places differ, in two bands
    rows = [(i, " ".join(w) + f"\nown {chr(97 + i % 26)}{chr(97 + i // 26)}") for i, w in enumerate(one + two)]
    short = [f"so {chr(97 + k)}b {chr(97 + k)}c {chr(97 + k)}d {last}" for last in ("here", "there") for k in range(20)]
    rows += [(100 + i, t) for i, t in enumerate(short)]
    tree = lines.Tree(long_words=4)
    got = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(docs([(i, t, "s") for i, t in rows]), tree=tree, small=small).collect()}
    want = brute.lines([x for x in rows if x[0] < 100], tree) | brute.lines([x for x in rows if x[0] >= 100], tree)
    assert got == want and all(not got[i].startswith("the same") for i in range(20, 40)) and all(got[i].startswith("the same") for i in range(20))
    assert [got[100 + i] == "" for i in range(40)] == [False] * 20 + [True] * 20
    if small:
        narrow = lines.Tree(long_words=4, fields=1)
        got = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(docs([(i, t, "s") for i, t in rows]), tree=narrow).collect()}
        assert got == brute.lines([x for x in rows if x[0] < 100], narrow) | brute.lines([x for x in rows if x[0] >= 100], narrow)


def test_lines_are_joined_without_broadcasts(docs, monkeypatch):
    asked = []
    monkeypatch.setattr(lines.F, "broadcast", lambda d: asked.append(d.count()) or d)
    line = "this is the long report that stands here"
    got = lines.drop_recurring_lines(docs([(i, f"{line}\nown {chr(97 + i)}", "s") for i in range(3)])).toPandas()
    assert sorted(got.n_dropped) == [0, 1, 1] and not any(asked)  # none but empty ones


def test_columns_of_any_name_survive(spark):
    names = ["gone", "__kept", "__lines", "__id", "of", "mark", "lost", "every", "kept", "salt", "template", "id", "pos", "first"]
    rows = [(i, f"a line of eight words stands right here today\n{chr(97 + i)}", *range(len(names))) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    got = lines.drop_recurring_lines(df).toPandas().set_index("doc_id")
    assert got[names].iloc[2].tolist() == list(range(len(names))) and got.n_dropped.sort_index().tolist() == [0, 1, 1]


def test_many_lines_and_awkward(docs, awkward):
    many = "\n".join(f"{chr(97 + i % 26)}{'q' * (i % 50)} common words in a rather long line" for i in range(3000))
    got = lines.drop_recurring_lines(docs([(1, many, "s"), (2, many + "\nlast one alone", "s")])).toPandas().set_index("doc_id")
    assert got.loc[2, "text"] == "last one alone" and got.loc[1, "text"] == many
    assert len(lines.drop_recurring_lines(awkward).toPandas()) == 9
    assert lines.drop_recurring_lines(awkward.limit(0)).count() == 0


def test_short_lines_and_wrapped_passages(docs):
    passage = "the old mill by\nthe river stood\nempty for\nforty years"
    rows = [(i, f"Les.\nonly{chr(97 + i)} here", "s") for i in range(20)] + [(100 + i, f"12\nown{chr(97 + i)} text", "s") for i in range(20)]
    rows += [(200, f"aa bb\n{passage}\ncc dd", "s"), (201, f"ee ff\n{passage}\ngg hh", "s"), (202, "the old mill by\nitself", "s"), (203, "13\n12 14", "s")]
    got = lines.drop_recurring_lines(docs(rows)).toPandas().set_index("doc_id").sort_index()
    assert got.loc[0, "n_dropped"] == 0 and (got.loc[1:19, "n_dropped"] == 1).all() and got.loc[1, "text"] == "onlyb here"
    assert got.loc[100, "n_dropped"] == 0 and (got.loc[101:119, "n_dropped"] == 1).all()
    assert got.loc[200, "n_dropped"] == 0 and got.loc[201, "text"] == "ee ff\ngg hh" and got.loc[[202, 203], "n_dropped"].eq(0).all()


# op6
def test_classifier_learns_from_rows_not_held_out(spark, docs):
    good, bad = "The men of the town went to the market and it was {} for them.", "ZZ### QQ$$$ {} WW%%% XX!!! "
    rows = [(i, (good if i % 3 else bad).format("w" * (i % 9 + 1)) * (1 + i % 5), "s") for i in range(150)] + [(900, None, "s"), (901, "", "s")]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(150)] + [(3, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = classifier.classify(docs(rows), labels).toPandas().set_index("doc_id")
    assert all(got.loc[i, "held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    held = got[got.held_out & (got.index < 150)]
    assert (held.predicted == (held.index % 3 > 0)).mean() > 0.95
    assert got.score.between(0, 1).all() and len(got) == 152
    none = classifier.classify(docs(rows[:5]), labels.limit(0)).toPandas()
    assert (none.score == 0.5).all()


def test_scores_are_the_log_density_ratio(spark, docs):
    """Densities from numpy, with covariances shrunk by hand, over features the operator computes."""
    rng = np.random.default_rng(31)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(50)]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(5, 40)))) + ("! #1 " if i % 2 else ". ") * int(rng.integers(1, 6)), "s") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    got = classifier.classify(docs(rows), labels).toPandas().set_index("doc_id").sort_index()
    table = classifier.features(docs(rows)).toPandas().set_index("doc_id").sort_index()
    x, learn = table[classifier.FEATURES].to_numpy(), np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in table.index])
    y, logp = table.index.to_numpy() % 2, []
    pooled = sum(np.cov(x[learn & (y == k)].T, bias=True) * (learn & (y == k)).sum() for k in (0, 1)) / learn.sum()
    for k in (0, 1):
        own = x[learn & (y == k)]
        s = (1 - classifier.POOLED) * np.cov(own.T, bias=True) + classifier.POOLED * pooled
        s = (1 - classifier.ROUND) * s + classifier.ROUND * np.trace(s) / len(s) * np.eye(len(s))
        d = x - own.mean(0)
        logp.append(np.log(len(own)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    want = 1 / (1 + np.exp(np.clip(logp[0] - logp[1], -700, 700)))
    assert np.allclose(got.score, want, atol=1e-6) and (got.predicted == (got.score >= 0.5)).all()


def test_classifier_awkward(spark, awkward):
    labels = spark.createDataFrame([(4, 1)], "doc_id bigint, quality int")
    got = classifier.classify(awkward, labels).toPandas()  # document 4 is held out: nothing to learn from
    assert len(got) == 9 and (got.score == 0.5).all() and got.doc_id.isna().sum() == 1 and not got[got.doc_id.isna()].held_out.any()
    assert (classifier.classify(awkward, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).toPandas().score == 1.0).all()  # the share of ones
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1), (None, 1), (4, None)], "doc_id bigint, quality int")
    got = classifier.classify(awkward, labels).toPandas()
    assert got.score.between(0, 1).all() and got[got.doc_id == 4].score.nunique() == 1 and got[got.doc_id.isin([1, 2])].score.nunique() == 1
    assert classifier.classify(awkward.limit(0), labels).count() == 0


# op7
@pytest.mark.parametrize("small", [200_000, 0])
def test_seats_go_to_the_highest_quotients(spark, small):
    rng = np.random.default_rng(2)
    cases = [(g, rng.integers(0, [60, 3, 1000, 1][g % 4], rng.integers(1, 13)).tolist(), int(rng.integers(0, 80))) for g in range(60)]
    table = spark.createDataFrame([(g, k, float(v)) for g, votes, _ in cases for k, v in enumerate(votes)], "group bigint, key bigint, votes double")
    groups = spark.createDataFrame([(g, n) for g, _, n in cases], "group bigint, seats bigint")
    got = {(r["group"], r["key"]): r["seats"] for r in mixing.apportion(table, groups, small).collect()}
    for g, votes, n in cases:
        assert [got[g, k] for k in range(len(votes))] == brute.seats(votes, n), (votes, n)


@pytest.mark.parametrize("sizes", [[100, 10, 1, 50, 0], [5], [0, 0], [1000, 1, 1, 1, 1], [7] * 9, [1, 2, 4, 8, 16, 32, 64, 128]])
def test_targets_stop_at_the_cap(spark, sizes):
    weights = [[5.0, 2.0, 1.0][i % 3] for i in range(len(sizes))]
    table = spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(zip(sizes, weights, strict=True))], "i int, size bigint, weight double")
    got = [r["target"] for r in sorted(mixing.targets(table).collect())]
    assert np.allclose(got, brute.targets(sizes, weights))


def test_mix_reaches_targets_and_reruns_agree(docs):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 60)), None if i % 17 == 0 else f"s{min(i % 7, 3)}") for i in range(700)]
    a = mixing.mix(docs(rows), shard_rows=50).toPandas().sort_values("doc_id")
    b = mixing.mix(docs(rows).repartition(5), shard_rows=50).toPandas().sort_values("doc_id")
    assert (a.taken.to_numpy() == b.taken.to_numpy()).all()
    source = pd.Series({i: s or "~" for i, _, s in rows})
    g = a.assign(s=source.loc[a.doc_id].to_numpy()).groupby("s").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), own=("source_size", "first"))
    assert (g["size"] == g.own).all() and ((g.taken - g.target).abs() <= 0.01 * g.target + 2).all() and (a.taken <= 2 * a["size"]).all()


def test_mix_is_what_a_plain_loop_takes(spark, docs):
    """Blocks, their order and the cut, by a loop over each shard's rows, with the operator's hashes."""
    rng = np.random.default_rng(21)
    rows = [(i if i % 23 else None, "w " * int(rng.integers(0, 40)), f"s{i % 3}" if i % 10 else None) for i in range(400)] + [(7, "a b", "s0"), (7, "a b", "s0")]
    got = mixing.mix(docs(rows), shard_rows=60, shard_blocks=10, small=0, carry=True).toPandas()
    assert len(got) == len(rows) and got.row.map(lambda r: r["score"]).eq("x").all()
    want = brute.mix(spark, [(i, t, x) for i, t, x in rows], 60, 10)
    seen = collections.defaultdict(list)
    for r in got.itertuples():
        seen[r.row["doc_id"], r.row["text"]].append(r.taken)
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}


def test_mix_awkward(awkward):
    got = mixing.mix(awkward).toPandas()
    assert len(got) == 9 and (got.taken <= 2 * got["size"]).all() and got[got.doc_id.isin([1, 2, 3])].taken.eq(0).all()
    assert got[got.doc_id == 6]["size"].iloc[0] == 30_000 and abs(got.taken.sum() - got.groupby("source_size").target.first().sum()) < 0.02 * got["size"].sum()
    assert mixing.mix(awkward.limit(0)).count() == 0 and mixing.mix(awkward.where("doc_id < 3")).toPandas().taken.eq(0).all()


# op8
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="nav-open"><header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div id=cookie-notice>We use cookies. Accept them all please.</div><div class="sidebar"><p>Read this long sidebar text, it is full of words and ends here.</p></div>
<article><h1>Title &amp; more</h1><p>First   para <b>bold</b><br>next&nbsp;line.<p>Second &lt;para&gt; with a <a href=x>link</a>.<div class="ad">Buy now!</div><blockquote>A quote.</blockquote><script>var t="</p>";</script><p>Third.</article>
<section class="comments"><p>Nice article, thanks a lot for it!</p></section><form>Name <input></form><aside>Related things.</aside><footer>&copy; Site</footer><!-- <p>no</p> --></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == ["Title & more", "First para bold next line.", "Second <para> with a link.", "A quote.", "Third."]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</p></p>", "plain", "<a " + "b" * 1000])
def test_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


@pytest.mark.parametrize("wrapper", ['div class="page with-sidebar"', 'div class="content has-comments"', "div id=main-search-page", 'div class="layout side-right"', "div role=main", "section id=adsRight"])
def test_wrappers_of_an_article_are_neutral(wrapper):
    page = f"<body><nav><a href=x>Home</a></nav><{wrapper}><article><h1>Title</h1><p>Text of the article stands here.</p><p>Yes.</article><div class=sidebar>More to read</div></{wrapper.split()[0]}><footer>f</footer>"
    assert html_text.main_text(page) == "Title\nText of the article stands here.\nYes."


@pytest.mark.parametrize("mark", ['class="post-comments"', 'class="articleFooter"', "id=entry-share", 'class="content-sidebar"', "role=complementary", "role=contentinfo", 'class="story-related"', 'class="ad-slot ad-top"', "hidden", 'style="display: none"'])
def test_marked_parts_go_wherever_they_are(mark):
    part = f"<div {mark}><p>This is a sentence that reads like prose, with commas, and it ends well.</p><p>So does this one, right here, after it.</p><p>{'Many words make no comment an article, ' * 80}and it ends.</p></div>"
    page = f"<body><main><article class='post comments-open'><h1>Title</h1><p>The text of the article, in one sentence that is long enough.</p>{part}<p>Its end.</p></article>{part}</main>{part}</body>"
    assert html_text.main_text(page).split("\n") == ["Title", "The text of the article, in one sentence that is long enough.", "Its end."]


def test_lists_cells_formulas_and_comments():
    page = "<body><div class=menu><a>x</a></div><div class=content><p>One long sentence is here, and it goes on for a while.</p><ul><li>first<li>second item</ul><table><tr><td>a<td>b</table><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be &amp;a<b>mp;</b> it.</p></div><div id=comments><article class=comment><p>I like this article a lot, thank you.</p></article></div><footer>f</footer>"
    assert html_text.main_text(page).split("\n") == ["One long sentence is here, and it goes on for a while.", "first", "second item", "a", "b", "Let x=2 be &amp; it."]


@pytest.mark.parametrize("part", ["<a x", "<div>", "<p>x", "<a '", "<!--", "<script>", "</x", "<b></p>", "<table><tr><td>x", "<a =  ", "&amp", "<ul><li>x", "<p>ab, cd "])
def test_long_broken_pages_take_linear_time(part):
    at = time.process_time()
    html_text.main_text(part * (1_000_000 // len(part)))
    assert time.process_time() - at < 30


def test_the_cut_has_fewer_errors_than_the_classifier_alone():
    model = html_training.fitted()
    alone, pages = html_text.Model(model.weights, 0.0, 0.0), html_training.labelled(150, 99)
    wrong = [sum(x != y for blocks, want in pages for x, y in zip(m.labels(blocks), want, strict=True)) for m in (alone, model)]
    assert wrong[1] < 0.9 * wrong[0] and wrong[1] < 0.04 * sum(len(b) for b, _ in pages)


def test_min_cut_is_minimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        s = rng.normal(0, 1, n)
        e = [(i, i + 1, float(rng.random())) for i in range(n - 1)] + [(0, n - 1, 0.4)] * (n > 2)
        cost = lambda side: sum(abs(s[i]) for i in range(n) if (s[i] > 0) != side[i]) + sum(w for a, b, w in e if side[a] != side[b])  # noqa: E731, B023
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_text.min_cut(list(s), e)) - best) < 1e-9


def test_pages_table(spark):
    p = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 6), (2, None, None, 6)], "page_id bigint, url string, html string, text int")
    got = html_text.extract(p).toPandas()
    assert len(got) == 3 and (got[got.page_id == 2].text == "").all() and got[got.page_id == 1].n_chars.iloc[0] == len(html_text.main_text(PAGE))
    assert html_text.extract(p.limit(0)).count() == 0


# op9
def brute_top(rows, every=50, k=5):
    """Best rows by Python integers, each row for itself."""
    sound = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in sound:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for m, j, w in sound if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, j) in enumerate(found)]
    return sorted(out)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.2, (230, 16)).astype(np.float32)
    v[100:140] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(500, None), (501, [1.0] * 15 + [None]), (502, [float("nan")] * 16), (550, [float("inf")] * 16), (None, [0.0] * 16)]  # take no part
    rows += [(503, []), (600, []), (504, [1.0, 2.0]), (650, [3.0, 1.0]), (7, v[7].tolist()), (50, v[50].tolist()), (100, v[9].tolist())]
    rows += [(800 + i, [3e5 * (i - 2)] * 16) for i in range(4)] + [(50, [2.0**30] * 16)]  # large components
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as score", "2 as dim", "3 as `row`")
    got = topk.top_k(df, rows=64, queries=3).toPandas()
    assert sorted(got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == brute_top(rows)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 7")).count() == 0


def test_top_k_matches_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i % 190, rng.normal(0, 0.3, 8).tolist()) for i in range(200)] + [(300, None), (350, [float("nan")] * 8), (None, [0.1] * 8), (400, [1.0] * 3)]
    matches_sql(spark, tmp_path, "op9_top_k", "embeddings", spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))


def test_scores_beyond_a_long_keep_their_order(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [1e31, 0.0]), (3, [-1e31, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).toPandas().sort_values("rank")
    assert got.vec_id.tolist() == [2, 1, 3] and got.score.tolist() == [2**63 - 1, 2**63 - 1, -(2**63)]


@pytest.mark.parametrize("levels", [32, 7, 1])
def test_a_block_is_searched_by_products(levels):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, (8192, 64))
    v = np.floor(256 * v / np.sqrt((v * v).sum(1))[:, None])
    ids, rows = rng.permutation(8192), np.arange(8192)
    began = time.process_time()
    q, vec, score, _ = topk.ImpactIndex(rows, ids, v, levels).best(rows[:256], v[:256])
    assert levels < 32 or time.process_time() - began < 1.2  # three seconds if each posting list is added by itself
    s = v[:256] @ v.T
    s[rows[:256], rows[:256]] = -1e18
    want = [(i, int(ids[j]), int(s[i, j])) for i in range(256) for j in np.lexsort((ids, -s[i]))[:5]]
    assert sorted(zip(q.tolist(), vec.tolist(), score.tolist(), strict=True)) == sorted(want)


def test_reading_stops_before_the_last_postings():
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(0, 32, (4000, 32)))
    index = topk.ImpactIndex(np.arange(4000), np.arange(4000), v)
    q, vec, score, _ = index.best(np.arange(40), v[:40])
    for i in range(40):
        s = (v @ v[i]).astype(int)
        s[i] = -(10**9)
        assert sorted(score[q == i].tolist()) == sorted(np.sort(s)[-5:].tolist())
    assert 0.5 < index.read / (v.size * 40) < 0.9


# op10
SMALL = pseudo_lm.Shape(classes=4, per_class=8, lengths=6, batch=64, part_words=600, span=3, every=2)


def test_network_gradient():
    shape = pseudo_lm.Shape(classes=4, per_class=4, lengths=2, hidden=3, batch=32, rounds=1)
    rng = np.random.default_rng(0)
    net = pseudo_lm.Network(shape, np.random.default_rng(1).normal(0, 0.3, pseudo_lm.Network(shape).flat.size))
    t, c = rng.integers(0, 16, 20), rng.integers(0, 17, (4, 20))
    every = np.exp([net.log_probs(np.full(20, k), c) for k in range(16)]).sum(0)
    assert np.allclose(every, 1, atol=1e-9)
    grad = net.gradient(t, c)
    for i in range(0, grad.size, 7):
        ends = []
        for step in (1e-5, -1e-5):
            moved = net.flat.copy()
            moved[i] += step
            ends.append(-pseudo_lm.Network(shape, moved).log_probs(t, c).mean())
        assert abs((ends[0] - ends[1]) / 2e-5 - grad[i]) < 1e-6
    before, past = net.log_probs(t, c).mean(), np.zeros_like(net.flat)
    for _ in range(200):
        net.step(t, c, past)
    assert net.log_probs(t, c).mean() > before + 0.5


def test_spelling_is_a_distribution():
    counts = pseudo_lm.Spelling.count(pseudo_lm.Words([b"ab", b"b"]), np.array([2.0, 3.0]))
    assert counts.sum() == 7 and counts[256 * 256 + ord("a")] == 2 and counts[256 * 256 + ord("b")] == 3 and counts[ord("a") * 256 + ord("b")] == 2
    s = pseudo_lm.Spelling(pseudo_lm.Shape(lengths=3), counts)
    assert np.isclose(np.exp(s.log_probs(pseudo_lm.Words([bytes([a, b]) for a in range(256) for b in range(256)]))).sum(), 1)
    whole = pseudo_lm.Spelling(pseudo_lm.Shape(lengths=999), counts)
    tail = [sum(np.exp(s.log_probs(pseudo_lm.Words([b"x" * n])) - whole.log_probs(pseudo_lm.Words([b"x" * n])))[0] for n in range(3, m)) for m in (10, 200)]
    assert tail[0] < tail[1] < 1 + 1e-9 and tail[1] > 0.999


def test_chunks_of_texts_do_not_change_what_is_encoded():
    texts = [None, "a b c d e f", "", "g " * 9, "é h", "a b c d e f g h i j k l"] * 5
    spelling = pseudo_lm.Spelling(SMALL, np.zeros(257 * 256))
    whole, ones = (list(pseudo_lm.Encoder([b"a", b"g"], s, spelling).encoded(texts)) for s in (SMALL, dataclasses.replace(SMALL, batch=0)))
    assert len(whole) == len(ones) == len(texts)
    for x, y, t in zip(whole, ones, texts, strict=True):
        assert x[0] == y[0] and len(x[0]) == 2 * len((t or "").split()) and np.isclose(x[1], y[1])
        assert all(np.array_equal(i, j) for i, j in zip(x[2:5], y[2:5], strict=True)) and np.allclose(x[5], y[5])
    assert any(len(x[2]) for x in whole)


def lm_corpus():
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 40), p=np.arange(60, 0, -1) / 1830)), "s") for i in range(80)]
    return rows + [(100, rows[7][1], "s"), (101, rows[8][1] + " " + rows[8][1], "s"), (102, None, "s"), (103, "", "s"), (None, rows[9][1], "s")]


def test_scores_are_the_sums_of_a_plain_loop(spark, docs):
    rows = lm_corpus()
    df = docs(rows)
    texts = df.selectExpr("monotonically_increasing_id() as row", "doc_id", f"xxhash64({SMALL.seed}, doc_id, text) as draw", "xxhash64(text) as mark", "text")
    counts = pseudo_lm.count(texts)
    vocabulary = pseudo_lm.vocabulary_of(counts, SMALL)
    spelling = pseudo_lm.spell(counts, vocabulary, SMALL)
    flat = pseudo_lm.train(pseudo_lm.encode(texts, vocabulary, spelling, SMALL), sum(len((t or "").split()) for _, t, _ in rows), SMALL)
    own = collections.Counter(w for _, t, _ in rows for w in (t or "").encode().lower().split())
    assert vocabulary == sorted(own, key=lambda w: (-own[w], w))[: SMALL.known]
    rare = [w for w in own if w not in vocabulary]
    assert np.allclose(spelling.logs, pseudo_lm.Spelling(SMALL, pseudo_lm.Spelling.count(pseudo_lm.Words(rare), np.array([own[w] for w in rare], float))).logs)
    net, pad = pseudo_lm.Network(SMALL, flat), None
    seen = [collections.Counter() for _ in rows]
    want, spans = np.zeros(len(rows)), []
    for n, (_, t, _) in enumerate(rows):
        w = [pad, pad, *(t or "").encode().lower().split(), pad, pad]
        logp = {}
        for i in range(2, len(w) - 2):
            ids = [SMALL.ids if x is pad else vocabulary.index(x) if x in vocabulary else SMALL.known + min(len(x), SMALL.lengths) - 1 for x in (w[i - 2], w[i - 1], w[i + 1], w[i + 2], w[i])]
            logp[i] = net.log_probs(np.array(ids[4:]), np.array(ids[:4])[:, None])[0] + (0 if w[i] in vocabulary else spelling.log_probs(pseudo_lm.Words([w[i]]))[0])
        want[n], free = sum(logp.values()), 0
        for i in range(2, len(w) - 2 - SMALL.span + 1):
            around = w[i - 2], w[i - 1], w[i + SMALL.span], w[i + SMALL.span + 1]
            code = [np.zeros(1, np.uint64) if x is pad else pseudo_lm.Words([x]).hashes() for x in around]
            if int(pseudo_lm._mixed(code)[0]) % SMALL.every == 0 and i >= free:
                free, inside = i + SMALL.span, tuple(w[i : i + SMALL.span])
                spans.append((n, around, inside, sum(logp[k] for k in range(i, free))))
                seen[n][around] += 1
                seen[n][around, inside] += 1
    total, alone = sum(seen, collections.Counter()), want.copy()
    for n, around, inside, logp in spans:
        there, same = total[around] - seen[n][around], total[around, inside] - seen[n][around, inside]
        want[n] += np.log((same + np.exp(logp)) / (there + 1)) - logp
    got = pseudo_lm.score(df, shape=SMALL).toPandas()
    got = got.set_index(got.doc_id.fillna(-1).astype(int)).loc[[-1 if i is None else i for i, _, _ in rows]]
    assert np.allclose(got.pll, want, rtol=1e-5, atol=1e-4)
    assert got.n_tokens.tolist() == [len((t or "").split()) for _, t, _ in rows]
    # a text that occurs twice scores higher than the network alone says, by its remembered spans
    assert got.loc[100, "pll"] > alone[80] + 2


@pytest.mark.parametrize("small", [200_000, 0])
def test_scores_do_not_depend_on_partitions(docs, small):
    df = docs(lm_corpus())
    a = pseudo_lm.score(df.repartition(7), shape=SMALL, small=small).toPandas().sort_values("doc_id")
    b = pseudo_lm.score(df.coalesce(1).orderBy("text"), shape=SMALL).toPandas().sort_values("doc_id")
    assert np.allclose(a.pll, b.pll, rtol=1e-6, atol=1e-5)


def test_lm_awkward(awkward):
    got = pseudo_lm.score(awkward, shape=pseudo_lm.Shape(rounds=1)).toPandas()
    assert len(got) == 9 and (got[got.doc_id.isin([1, 2, 3])].n_tokens == 0).all() and got[got.n_tokens > 0].pll.notna().all()
    assert got[got.doc_id == 6].n_tokens.iloc[0] == 30_000 and got[got.doc_id == 4].pll.nunique() == 1
    assert pseudo_lm.score(awkward.limit(0)).count() == 0
