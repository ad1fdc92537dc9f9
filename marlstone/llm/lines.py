"""Line dedup by a log-template tree, in DataFrame functions only.

Variable fields of a line (words with digits, ``@``, ``=``, ``_`` or slashes) become a wildcard. A tree of fixed
depth parses what is left: the first level is the number of words, the next ``depth`` levels are the leading
words, and a leaf holds templates. Inside a leaf templates merge by the likeness of their words, place by place:
those that differ in few places are one template, in which the places that differ are further fields.

For that a template is nine places (a word each, or a few words of a longer line), held as three bands of hashes.
Two templates that differ in two places share a band, so only templates of a leaf that share one with another are
looked at. Each of them is held once for every choice of two places left out: those that agree in all other places
are alike enough, and are linked to the least of them. So all that are alike meet, however many share a band, and no
pairs are listed. Linked templates are one.

A template that recurs across documents is dropped from all of them but the one with the smallest id, so that no
text is lost altogether; ``keep_first=False`` drops it there too. Templates with few fixed words must recur more
often, since short lines meet by chance. A short line also counts in runs: the fewest lines from it on, and up to
it, that make a long template together (blank lines between do not count), so that a wrapped passage goes like a
long line. A line of variable fields alone stands for itself.

Only numbers are shuffled until the lines to drop are known: a line is its template's hash and bands, and what a
document loses is a bit mask over its lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import components, fresh, looked_up, result, scope, written

WILDCARD = "<*>"
#: A whole word with a variable character, from its first character on (no backtracking in long words).
_VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@=_/\\]*+[0-9@=_/\\][^\x20\x09-\x0D]*+"
#: Nine places in three bands; each place has a 20-bit hash with a free bit above.
BANDS, LANES, BITS = 3, 9, 20


@dataclass(frozen=True)
class Tree:
    depth: int = 1
    long_words: int = 8
    long_docs: int = 2
    short_docs: int = 20
    keep_first: bool = True
    #: Places in which two templates of a leaf may differ: one of ``alike`` (4 or more), and at most ``fields`` (0 to 2).
    alike: int = 4
    fields: int = 2

    def __post_init__(self) -> None:
        if self.alike < 4 or not 0 <= self.fields <= 2:
            raise ValueError("bands find templates that differ in two places at most, one of four")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _split(line: Column) -> Column:
    return F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")


#: Hashes of the places of the words ``w``; place i holds the words from i n / 9 to (i + 1) n / 9.
_PLACES = f"""transform(sequence(0, {LANES - 1}), i -> if((i + 1) * size div {LANES} > i * size div {LANES},
    hash(slice(w, cast(i * size div {LANES} as int) + 1, cast((i + 1) * size div {LANES} - i * size div {LANES} as int))) & {2**BITS - 1}, 0))"""


def _band(b: int) -> str:
    return " | ".join(f"shiftleft(cast(places[{i}] as bigint), {(BITS + 1) * (i % 3)})" for i in range(3 * b, 3 * b + 3))


def templates(docs: DataFrame, id_col: str, text_col: str, tree: Tree) -> DataFrame:
    """One row per line or run that can recur: id, text hash, first position and how many more, its template, the
    number of fixed words, and for a line its leaf, size and bands."""

    def parsed(x: Column, i: Column) -> Column:
        varies = x.rlike(r"[0-9@=_/\\]")
        own = F.struct(_split(x).alias("w"), _split(F.when(varies, F.regexp_replace(x, _VARIABLE, WILDCARD))).alias("m"))
        return F.struct(i.alias("pos"), own.alias("own"))

    def masked(x: Column) -> Column:
        own = x["own"]
        fixed = F.when(own["m"].isNull(), F.size(own["w"])).otherwise(F.size(F.array_remove(own["m"], WILDCARD)))
        w = F.when(own["m"].isNull() | (fixed == 0), own["w"]).otherwise(own["m"])
        return F.struct(x["pos"].alias("pos"), w.alias("w"), F.when(fixed == 0, F.size(own["w"])).otherwise(fixed).alias("fixed"))

    def placed(x: Column) -> Column:
        return F.struct(x["pos"].alias("pos"), F.lit(0).alias("more"), F.size(x["w"]).alias("size"), F.xxhash64(F.size(x["w"]), x["w"]).alias("template"), x["fixed"].alias("fixed"), x["w"].alias("w"))

    split = F.filter(F.transform(_lines(F.col(text_col)), parsed), lambda x: F.size(x["own"]["w"]) > 0)
    lines = F.transform(F.transform(split, masked), placed)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("mark"), lines.alias("p"))
    # each line has a fixed word, so a run has long_words lines at most
    k = tree.long_words
    count = f"aggregate({{0}}, struct(0 as s, 0 as n), (a, x) -> if(a.s >= {k}, a, struct(a.s + x.fixed as s, a.n + 1 as n)), a -> if(a.s >= {k}, a.n, 0))"
    ahead = count.format(f"slice(p, i + 1, {k})")
    behind = count.format(f"reverse(slice(p, greatest(i + 2 - {k}, 1), least(i + 1, {k})))")
    spans = f"flatten(transform(p, (x, i) -> if(x.fixed < {k}, array(struct(i + 1 as at, {ahead} as n), struct(i + 2 - {behind} as at, {behind} as n)), array())))"
    run = (
        "struct(p[r.at - 1].pos as pos, p[r.at + r.n - 2].pos - p[r.at - 1].pos as more, -r.n as size,"
        f" xxhash64(r.n, transform(slice(p, r.at, r.n), x -> x.template)) as template, {k} as fixed, cast(null as array<string>) as w)"
    )
    rows = rows.withColumn("runs", F.expr(f"if(exists(p, x -> x.fixed < {k}), array_distinct(filter({spans}, r -> r.n > 1)), null)"))
    rows = rows.select("id", "mark", F.explode(F.expr(f"concat(p, coalesce(transform(runs, r -> {run}), array()))")).alias("x")).select("id", "mark", "x.*")
    leaf = F.expr(f"if(w is null, null, xxhash64(size, slice(w, 1, {tree.depth})))")
    rows = rows.withColumns({"leaf": leaf, "places": F.expr(f"if(size < 4, null, {_PLACES})")})
    return rows.withColumns({f"s{b}": F.expr(_band(b)) for b in range(BANDS)}).drop("w", "places")


def _keys() -> Column:
    """Band keys of a template: pairs of bands of a short one, which may differ in one place, else single bands. The
    last two bits tell which."""

    def hashed(groups: list[tuple[int, ...]]) -> str:
        return "array(" + ", ".join(f"xxhash64(leaf, {j}, {', '.join(f's{b}' for b in g)}) & -4L | {j}L" for j, g in enumerate(groups)) + ")"

    return F.expr(f"if(size < 8, {hashed([(0, 1), (0, 2), (1, 2)])}, {hashed([(0,), (1,), (2,)])})")


def _masks(tree: Tree) -> Column:
    """Of a template with the bit mask ``bands`` of its keys that others have too: each choice of places to leave out
    that can be like another's, with the hash of all other places, and the places left out and their hashes."""

    def left_out(places: tuple[int, ...], needs: int) -> str:
        rest = [f"s{b} & {sum(2**BITS - 1 << (BITS + 1) * (i % 3) for i in range(3 * b, 3 * b + 3) if i not in places)}L" for b in range(BANDS)]
        own = [f"cast(shiftright(s{i // 3}, {(BITS + 1) * (i % 3)}) & {2**BITS - 1} as int)" for i in places]
        made = f"struct(xxhash64(leaf, {sum(1 << i for i in places)}, {', '.join(rest)}) as key, {places[0]} as i, {places[-1]} as j, {own[0]} as x, {own[-1]} as y)"
        return f"if(bands & {needs} = {needs}, {made}, null)"

    # by the order of _keys: a pair of bands is named by the band outside it, backwards
    short = [left_out((i,), 1 << (BANDS - 1 - i // 3)) for i in range(LANES)]
    one, two = ([left_out(p, sum(1 << b for b in range(BANDS) if b not in {i // 3 for i in p})) for p in combinations(range(LANES), n)] for n in (1, 2))
    masks = f"case least(size div {tree.alike}, {tree.fields}) when 0 then array() when 1 then if(size < 8, array({', '.join(short)}), array({', '.join(one)})) else array({', '.join(two)}) end"
    return F.expr(f"filter({masks}, x -> x is not null)")


def _looked(rows: DataFrame, table: DataFrame, key: str, spread: str, small: int, how: str = "inner") -> DataFrame:
    return looked_up(rows, table, key, spread, small, how, salts=4)


def near(found: DataFrame, small: int) -> DataFrame:
    """Written table of the templates that share a band with another, and the bit mask ``bands`` of the keys shared."""
    with scope(found.sparkSession) as paths:
        keys = found.where("s0 is not null").select("id", "template", F.explode(_keys()).alias("key"))
        shared = keys.groupBy("key").agg(F.min("template").alias("low"), F.max("template").alias("high")).where("low < high")
        keys = _looked(keys, written(shared.select("key"), "shared"), "key", "id", small)
        return result(keys.groupBy("template").agg(F.bit_or(F.expr("shiftleft(1, cast(key & 3 as int))")).alias("bands")), "near", paths)


def merged(rows: DataFrame, tree: Tree, small: int) -> DataFrame:
    """Written table of ``template``, ``root`` and ``left``: the merged template it is part of, and its fixed words.
    Templates that merge with no other are left out."""
    with scope(rows.sparkSession) as paths:
        return result(_merged(rows, tree, small), "merged", paths)


def _merged(rows: DataFrame, tree: Tree, small: int) -> DataFrame:
    held = rows.groupBy("template", "leaf", "size", "bands", *(f"s{b}" for b in range(BANDS))).agg(F.min("fixed").alias("fixed"))
    held = written(held, "held")
    masks = written(held.select("template", F.explode(_masks(tree)).alias("m")).select("template", "m.*"), "masks")
    varies = F.expr("if(min(x) < max(x), shiftleft(1, min(i)), 0) | if(min(y) < max(y), shiftleft(1, min(j)), 0)")
    groups = masks.groupBy("key").agg(F.min("template").alias("low"), F.max("template").alias("high"), varies.alias("apart"))
    groups = written(groups.where("low < high").drop("high"), "groups")
    links = _looked(masks.select("key", "template"), groups.drop("apart"), "key", "template", small)
    tops = components(links.select(F.col("template").alias("u"), F.col("low").alias("v"))).withColumnRenamed("u", "template")
    root = F.coalesce("v", "template").alias("root")
    apart = _looked(groups.select(F.col("low").alias("template"), "key", "apart"), tops, "template", "key", small, "left").groupBy(root).agg(F.bit_or("apart").alias("apart"))
    apart = written(apart, "apart")
    members = held.join(tops, "template", "left").select("template", root, "size", "fixed")
    members = written(_looked(members, apart, "root", "template", small), "members")
    left = F.expr(f"cast(greatest(0, min(fixed) - bit_count(max(apart)) * ((max(size) + {LANES - 1}) div {LANES})) as int)")
    fields = written(members.groupBy("root").agg(left.alias("left")), "fields")
    return _looked(members.select("template", "root"), fields, "root", "template", small)


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: Tree = Tree(), small: int = 0) -> DataFrame:
    """The input's rows and columns with the text column rewritten, and ``n_lines``, ``n_dropped`` (bigint) added.

    Lines are parts between ``\\n``; the lines kept are joined by ``\\n`` unchanged. A null text stays null and
    has no lines; an empty one has one line. Rows without an id count as one document that comes last. Rows
    that repeat an id count as one document; each keeps its own lines. Of documents that tie the smallest id
    keeps the line. Blank lines inside a run go with it. Texts may be of any length. An empty table gives no rows.
    Existing columns named ``n_lines`` or ``n_dropped`` are replaced; all others stay, whatever their names.

    Tables of at most ``small`` rows of a few numbers are broadcast, larger ones joined over salted keys. By default
    none is: many such tables at once fill a small driver.
    """
    docs = docs.drop(*({"n_lines", "n_dropped"} & set(docs.columns)))
    last = F.lit(2**63 - 1)
    found = written(templates(docs, id_col, text_col, tree).withColumn("id", F.coalesce("id", last)), "lines")
    # most templates stand alone; only rows of those that occur again or are near another go on
    again = found.groupBy("template").agg(F.count("*").alias("rows")).where("rows > 1").select("template")
    met = written(again.join(near(found, small), "template", "full"), "met")
    met = written(_looked(found, met, "template", "id", small), "rows")
    names = merged(met.where("bands is not null"), tree, small)
    met = _looked(met.select("id", "mark", "pos", "more", "template", "fixed"), names, "template", "id", small, "left")
    met = met.withColumns({"template": F.coalesce("root", "template"), "fixed": F.coalesce("left", "fixed")}).drop("root", "left")
    place = met.groupBy("template", "id").agg(F.min("fixed").alias("fixed"))
    place = place.groupBy("template").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min("fixed").alias("fixed"))
    recurs = (F.col("fixed") >= tree.long_words) & (F.col("n") >= tree.long_docs) | (F.col("n") >= tree.short_docs)
    place = written(place.where(recurs).select("template", "first"), "recurring")
    gone = _looked(met.drop("fixed"), place, "template", "id", small)
    if tree.keep_first:
        gone = gone.where("id <> first")
    bit = F.expr("shiftleft(1L, pos % 64)")
    gone = gone.select("id", "mark", F.explode(F.expr("sequence(pos, pos + more)")).alias("pos"))
    gone = gone.groupBy("id", "mark", F.expr("pos div 64").cast("int").alias("block")).agg(F.bit_or(bit).alias("bits"))
    of, mark, lost, every, kept = fresh(docs, "of", "mark", "lost", "every", "kept")
    gone = gone.groupBy(F.col("id").alias(of), F.col("mark").alias(mark)).agg(F.collect_list(F.struct("block", "bits")).alias(lost))
    on = (F.coalesce(docs[id_col].cast("bigint"), last) == gone[of]) & (F.xxhash64(docs[text_col]) == gone[mark])
    out = docs.join(gone, on, "left").drop(of, mark)
    # masks by block, with zeros between, so that a line finds its bit at once
    dense = (
        f"transform(array(map_from_entries({lost})), m -> transform(sequence(0, array_max(transform({lost}, g -> g.block))),"
        " b -> coalesce(m[b], 0L)))"
    )
    keep = f"transform({dense}, d -> filter({every}, (x, i) -> shiftright(coalesce(get(d, cast(i div 64 as int)), 0L), i % 64) & 1 = 0))[0]"
    text = F.col(f"`{text_col}`")
    out = out.withColumn(every, F.when(text.isNotNull(), _lines(text)))
    out = out.withColumn(kept, F.when(F.col(lost).isNull(), F.col(every)).otherwise(F.expr(keep)))

    def size(name: str) -> Column:
        return F.when(F.col(name).isNull(), 0).otherwise(F.size(name)).cast("bigint")

    left = F.when(F.col(lost).isNull(), text.cast("string")).otherwise(F.array_join(kept, "\n"))
    return out.withColumns({"n_lines": size(every), "n_dropped": size(every) - size(kept), text_col: left}).drop(lost, every, kept)
