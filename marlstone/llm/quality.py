"""Quality rules by distribution divergence, in DataFrame functions only.

Base rules look at one text. The method compares two histograms of a document, its character classes and its
common words, with those of its language, by Jensen-Shannon distance. All references are learned from the whole
corpus: a language's common words are those that make up half a percent or more of its words (so 200 at most),
with their shares; of each character class the median share over the language's documents, which junk can't move.
Languages with less than a hundredth of all words, and no language, are one group. Texts below a length are not
judged by a histogram that is too thin to say anything.

Words of the histogram are runs of letters in lower case; words of the base rules lie between ASCII white space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import words, written

OTHER = "other"

#: Classes counted among what is neither letter nor digit. Digits count with the letters without case: numbers,
#: addresses and hashes in good prose are no fault of it.
_CLASSES = {"spaces": r"\x20\x09-\x0D", "marks": r".,;:'\"()\-", "cries": "!?"}
CLASSES = ["upper", "plain", *_CLASSES, "symbols"]


@dataclass(frozen=True)
class Rules:
    """Limits. Distances are Jensen-Shannon distances (0 to 1); guards are lengths."""

    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    max_class_distance: float = 0.17
    min_class_chars: int = 60
    max_word_distance: float = 0.4
    min_histogram_words: int = 30
    #: A common word is one in so many words of its language; a language of its own has one in so many of all words.
    common_of: int = 200
    language_of: int = 100
    #: Bins of a share, for its median.
    bins: int = 1000


def _kept_of(text: Column, chars: str) -> Column:
    """How many characters of the set the text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def letters(text: Column) -> Column:
    """Runs of letters in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def _window_hashes(w: str, window: int) -> str:
    """64-bit hashes of all windows of array column ``w``, which has more words than a window, from its words' hashes."""
    parts = ", ".join(f"h[i + {k}]" for k in range(window))
    return f"transform(array(transform({w}, x -> xxhash64(x))), h -> transform(sequence(0, size(h) - {window}), i -> xxhash64({parts})))[0]"


def repeated_words(w: str, window: int) -> Column:
    """Words in windows found twice or more in array column ``w``, each word counted once.

    Windows are compared by 64-bit hash within one text. Only texts with an equal pair are sorted.
    """
    hashes = _window_hashes(w, window)
    pairs = "zip_with(s, slice(s, 2, size(s)), (a, b) -> if(a.x = b.x, array(a.i, b.i), cast(array() as array<int>)))"
    covered = (
        f"aggregate(array_sort(array_distinct(flatten({pairs}))), named_struct('last', -{window}, 'sum', 0L),"
        f" (z, p) -> named_struct('last', p, 'sum', z.sum + least({window}, p - z.last)), z -> z.sum)"
    )
    spread = f"transform(array(array_sort(transform(h, (x, i) -> named_struct('x', x, 'i', i)))), s -> {covered})[0]"
    found = f"transform(array({hashes}), h -> if(size(array_distinct(h)) = size(h), 0L, {spread}))[0]"
    return F.expr(f"if(size({w}) <= {window}, 0L, {found})")


def common_words(docs: DataFrame, text_col: str, lang_col: str, rules: Rules) -> dict[str, dict[str, float]]:
    """Language group to its common words, most frequent first, with their shares of all its words.

    At most ``language_of`` + 1 groups of ``common_of`` words reach the driver.
    """
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    counts = docs.select(lang.cast("string").alias("lang"), F.explode(letters(F.col(text_col).cast("string"))).alias("word"))
    counts = written(counts.groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    named = counts.groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("lang").isNotNull() & (F.col("n") * rules.language_of >= total))
    sizes = {r["lang"]: r["n"] for r in named.collect()}
    rest = total - sum(n for lang, n in sizes.items() if lang != OTHER)
    sizes[OTHER] = rest
    group = F.when(F.col("lang").isin([x for x in sizes if x != OTHER]), F.col("lang")).otherwise(OTHER)
    least = F.coalesce(*(F.when(F.col("lang") == k, F.lit(n)) for k, n in sizes.items()))
    often = counts.groupBy(group.alias("lang"), "word").agg(F.sum("n").alias("n")).where(F.col("n") * rules.common_of >= least)
    found: dict[str, dict[str, float]] = {k: {} for k in sizes}
    for r in sorted(often.collect(), key=lambda r: (-r["n"], r["word"])):
        found[r["lang"]][r["word"]] = r["n"] / sizes[r["lang"]]
    return found


def base_statistics(docs: DataFrame, common: dict[str, dict[str, float]], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules(), carry: bool = False) -> DataFrame:
    """doc_id, language group, counts for the base rules and the two histograms; with ``carry`` the whole row too."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    lang = F.when(lang.isin([x for x in common if x != OTHER]), lang).otherwise(OTHER)
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    d = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), t.alias("t"), *row)
    d = d.withColumns({"w": words(F.col("t")), "rest": F.regexp_replace("t", r"[\p{L}0-9]+", "")})
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain, upper = F.length("t") - F.length("rest"), F.length(F.regexp_replace("t", r"[^\p{Lu}]+", ""))
    counts = {k: _kept_of(F.col("rest"), c) for k, c in _CLASSES.items()}
    d = d.withColumns({"n_chars": F.length("t"), "plain": plain, "upper": upper, "lines": lines, "letters": letters(F.col("t")), **counts})
    every = sorted({x for c in common.values() for x in c}) or [""]
    d = d.withColumn("frequent", F.concat(F.lit(" "), F.array_join(F.filter("letters", lambda x: x.isin(every)), "  "), F.lit(" ")))
    others = F.col("n_chars") - F.col("plain") - sum((F.col(k) for k in counts), F.lit(0))
    classes = F.array(F.col("upper"), F.col("plain") - F.col("upper"), *(F.col(k) for k in counts), others)
    # one list a group: a common word's count is what the text of frequent words loses without it
    lists = F.coalesce(*(F.when(F.col("lang") == k, F.array(*map(F.lit, c))) for k, c in common.items() if c), F.array().cast("array<string>"))
    d = d.withColumn("list", lists)
    of = F.expr("transform(list, c -> cast((length(frequent) - length(replace(frequent, concat(' ', c, ' '), ''))) / (length(c) + 2) as bigint))")
    return d.select(
        "doc_id",
        "lang",
        F.size("w").cast("bigint").alias("n_words"),
        (F.col("n_chars") - F.col("spaces")).cast("bigint").alias("word_chars"),
        _kept_of(F.col("rest"), r"#*$%&|<>").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words("w", rules.repeat_window).alias("n_repeat_words"),
        "n_chars",
        F.size("letters").alias("n_letters"),
        classes.cast("array<bigint>").alias("classes"),
        of.alias("common"),
        *(["row"] if carry else []),
    )


def class_references(stats: DataFrame, rules: Rules) -> dict[str, list[float]]:
    """Language group to the median share of each character class, scaled to one: the middle of the median's bin.

    Shares are counted by bin, so the result doesn't depend on how the data are partitioned.
    """
    share = stats.where("n_chars > 0").select("lang", "n_chars", F.posexplode("classes").alias("class", "n"))
    bins = share.groupBy("lang", "class", F.expr(f"n * {rules.bins} div n_chars").alias("bin")).agg(F.count("*").alias("n"))
    counts: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in bins.collect():  # at most so many bins a class of a group
        counts.setdefault((r["lang"], r["class"]), []).append((r["bin"], r["n"]))
    found: dict[str, list[float]] = {}
    for (lang, kind), rows in counts.items():
        left = (sum(n for _, n in rows) + 1) // 2
        for at, n in sorted(rows):
            left -= n
            if left <= 0:
                found.setdefault(lang, [0.0] * len(CLASSES))[kind] = (at + 0.5) / rules.bins if at < rules.bins else 1.0
                break
    return {lang: [x / sum(shares) for x in shares] for lang, shares in found.items()}


def _distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares; null if either is null."""
    part = "(a) * log2(a / ((a + b) / 2))"
    term = f"if(a > 0, {part}, 0D) + if(b > 0, {part.replace('(a)', '(b)').replace('log2(a', 'log2(b')}, 0D)"
    return F.expr(f"if({p} is null or {q} is null, null, sqrt(greatest(0D, aggregate(zip_with({p}, {q}, (a, b) -> {term}), 0D, (z, x) -> z + x) / 2)))")


def _listed(by: dict[str, list[float]]) -> Column:
    """The list of a row's language group, as a literal; null for a group without one."""
    kinds = [F.when(F.col("lang") == k, F.array(*(F.lit(float(x)) for x in v))) for k, v in by.items() if v]
    return F.coalesce(*kinds, F.lit(None).cast("array<double>"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules(), carry: bool = False) -> DataFrame:
    """One row per input row with counts, ``base_failed``, the distances and ``kept``.

    Null and empty texts have no words and fail the base rules. Texts of any length are read whole. Rows without a
    language, or with a rare one, are judged as one group. Repeated rows are judged alike; of equally frequent words
    all are common or none. Columns besides the three named are not read, whatever their names, but ``carry`` returns
    them in a struct ``row``. An empty table gives no rows.
    """
    common = common_words(docs, text_col, lang_col, rules)
    # written once: the references and the verdicts are made of it
    d = written(base_statistics(docs, common, id_col, text_col, lang_col, rules, carry), "statistics")
    share = "transform({0}, x -> x / cast({1} as double))"
    rest = "concat({0}, array(greatest(0D, 1D - aggregate({0}, 0D, (z, x) -> z + x))))"
    d = d.withColumns({
        "p": F.expr(f"if(n_chars > 0, {share.format('classes', 'n_chars')}, null)"),
        "q": _listed(class_references(d.drop("row"), rules)),
        "pw": F.expr(f"if(n_letters > 0, {rest.format(share.format('common', 'n_letters'))}, null)"),
        "qw": F.expr("cast(null as array<double>)") if not any(common.values()) else _listed({k: [*c.values(), max(0.0, 1 - sum(c.values()))] for k, c in common.items() if c}),
    })
    d = d.withColumns({"class_distance": _distance("p", "q"), "word_distance": _distance("pw", "qw")})
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    odd = (F.col("n_chars") >= rules.min_class_chars) & (F.col("class_distance") > rules.max_class_distance)
    odd = odd | ((F.col("n_letters") >= rules.min_histogram_words) & (F.col("word_distance") > rules.max_word_distance))
    d = d.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(odd, F.lit(False)))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return d.select("doc_id", *counts, "base_failed", "kept", "class_distance", "word_distance", *(["row"] if carry else []))
