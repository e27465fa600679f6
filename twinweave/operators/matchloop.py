"""Matching along the containment tree: containers first, then what they contain.

Objects have id, parent, text, code and number. A level takes the matches of the level above (left_id,
right_id) and goes on with what is still unmatched, in three stages: identical objects under matched
containers; under matched containers the nearest similar ones, by the candidate walk to its end; identical objects
whose containers don't match (they moved).

No pair of objects is listed: the walk asks for each class of equal right objects only for the nearest left one. For that the
left classes of a container are dealt in lists of some CHUNK, and a right class is compared with the lists of its
container where it stands, so a large container is many tasks and each right class leaves a row for each list. Where that
would be over FEW comparisons, what can't be beaten is looked for first: classes with the same number, then texts within
CLOSE edits, of which most pairs fail on their codes' bits alone; only right classes that may still have a nearer one meet the
lists. (The pairs of codes within a container still grow with the product of its sides' classes that have no identical partner.)

The code is that of the text (kernels.string_code); it is made here, for the few objects that reach the walk, unless they bring it.

A null text is an empty one; a null number is like another null number and unlike any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.functions import kernels, similarity
from twinweave.operators import matching
from twinweave.operators.walk import identical, key_of, walk
from twinweave.storage import written

LEAST = 0.5
#: Left classes of a container in one list.
CHUNK = 256
#: Comparisons that are made without looking for the closest first, and those of a task otherwise.
FEW = 2_000_000
#: Edits of texts that are looked for first.
CLOSE = 3
#: Bits of a code that an edit of a character changes at most: pairs of bytes around it go and come, of ASCII two each.
EDIT_BITS, WIDE_EDIT_BITS = 4, 10
_IDS = ["left_id", "right_id"]
_KEYS = ("text", "number")


def _without(rows: DataFrame, done: DataFrame, side: str) -> DataFrame:
    return rows.join(done.select(F.col(f"{side}_id").alias("id")), "id", "left_anti")


def plain(rows: DataFrame) -> DataFrame:
    """With null texts as empty ones."""
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


def coded(rows: DataFrame) -> DataFrame:
    """With the texts' codes, each distinct text's made once."""
    if "code" in rows.columns:
        return rows
    # small tables that take long: not left to a few tasks
    texts = rows.select("text").repartition(rows.sparkSession.sparkContext.defaultParallelism, "text").distinct()
    return rows.join(texts.withColumn("code", kernels.string_code(F.col("text"))), "text")


def _distance(text: Column, number: Column) -> Column:
    return F.round(matching.weighted_distance([(text, 50.0), (number, 10.0)]), 9)


def _chunked(left: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Left classes with the number of their list (_chunk) among those with their keys, and how many lists keys have."""
    sizes = left.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    met = left.join(sizes.select(key_of(*keys).alias("_same"), "_chunks"), key_of(*keys) == F.col("_same")).drop("_same")
    return met.withColumn("_chunk", F.pmod(F.xxhash64("cls"), "_chunks")).drop("_chunks"), sizes


def _in_lists(left: DataFrame, right: DataFrame, tasks: int = 0) -> DataFrame:
    """(right_cls, _near) by comparing each right class with all left ones of its box, a row for each list."""
    lists = _chunked(left, "box")[0].groupBy("box", "_chunk").agg(F.collect_list(F.struct("cls", "text", "code", "number")).alias("_lefts"))

    def apart(x: Column) -> Column:
        dist = _distance(matching.text_distance(x["text"], F.col("text")), matching.unlike(x["number"], F.col("number")))
        return F.struct(dist.alias("dist"), x["cls"].alias("left_cls"))

    alike = F.filter("_lefts", lambda x: similarity.cosine(x["code"], F.col("code")) >= LEAST)
    near = F.array_min(F.filter(F.transform(alike, apart), lambda x: x["dist"] <= matching.TOO_FAR))
    met = right.join(lists, "box")
    met = met.repartition(tasks) if tasks else met
    return met.select(F.col("cls").alias("right_cls"), near.alias("_near")).filter(F.col("_near").isNotNull())


def _paired(left: DataFrame, right: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Pairs of a left class (l_cls, l_text ...) and a right one with equal keys, a list of left ones in one place; tasks
    follow the comparisons, since the tables are small."""
    dealt, sizes = _chunked(left, *keys)
    same = key_of(*keys).alias("_same")
    dealt = dealt.select(same, "_chunk", *[F.col(c).alias(f"l_{c}") for c in left.columns]).repartition(tasks, "_same", "_chunk")
    lists = sizes.select(same, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_chunk"))
    asked = right.withColumn("_same", key_of(*keys)).join(lists, "_same").repartition(tasks, "_same", "_chunk")
    return asked.join(dealt, ["_same", "_chunk"]).drop("_same", "_chunk")


def _starts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(box, _start): how many characters all texts of a box begin with, those of its first and last text; edits need no look at them."""
    ends = left.select("box", "text").unionByName(right.select("box", "text")).groupBy("box").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    same = lambda k: F.col("a").substr(k, F.lit(1)) == F.col("b").substr(k, F.lit(1))
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length("a"), F.length("b")), F.lit(1)))
    return ends.select("box", F.aggregate(places, F.lit(0), lambda n, k: F.when((n == k - 1) & same(k) & (F.col("a") != ""), k).otherwise(n)).alias("_start"))


def _nearest(pairs: DataFrame, unlike: float) -> DataFrame:
    """(right_cls, _near): of each right class's pairs the nearest that isn't too far."""
    alike = pairs.filter(similarity.cosine(F.col("l_code"), F.col("code")) >= LEAST)
    edits = F.levenshtein(F.col("l_end"), F.col("end")) / F.greatest("l_size", "size", F.lit(1)).cast("double")
    alike = alike.withColumn("dist", _distance(edits, F.lit(unlike)))
    near = alike.filter(F.col("dist") <= matching.TOO_FAR).groupBy(F.col("cls").alias("right_cls"))
    return near.agg(F.min(F.struct("dist", F.col("l_cls").alias("left_cls"))).alias("_near"))


def _closest_first(left: DataFrame, right: DataFrame, tasks: int) -> DataFrame:
    """As _in_lists, which gets only the right classes for which neither the same number nor CLOSE edits settle it."""
    ascii_, starts = F.octet_length("text") == F.length("text"), _starts(left, right)
    columns = ["cls", "box", "text", "number", "code", ascii_.alias("ascii"), F.length("text").alias("size"), F.expr("substr(text, _start + 1)").alias("end")]
    left, right = (d.join(starts, "box").select(*columns) for d in (left, right))
    first = written(_nearest(_paired(left, right, ["box", "number"], tasks), 0.0), "near")
    # whoever has another number is at least this far
    settled = first.filter(F.col("_near.dist") < F.round(F.lit(10.0 / 60.0), 9)).select(F.col("right_cls").alias("cls"))
    open_ = right.join(settled, "cls", "left_anti")
    other = _paired(left, open_, ["box"], tasks).filter(~F.col("number").eqNullSafe(F.col("l_number")))
    bits = F.when(F.col("ascii") & F.col("l_ascii"), EDIT_BITS * CLOSE).otherwise(WIDE_EDIT_BITS * CLOSE)
    close = other.filter(similarity.hamming(F.col("l_code"), F.col("code")) <= bits).filter(F.levenshtein(F.col("l_end"), F.col("end"), CLOSE) >= 0)
    second = written(_nearest(close, 1.0), "near")
    best = first.unionByName(second).groupBy("right_cls").agg(F.min("_near").alias("_near"))
    # further edits make the longer text longer by as many at most
    more = F.lit(CLOSE + 1.0)
    bound = _distance(more / (F.length("text") + more), F.lit(1.0))
    still = (bound <= matching.TOO_FAR) & (F.col("_near").isNull() | (F.col("_near.dist") >= bound))
    rest = right.join(best.select(F.col("right_cls").alias("cls"), "_near"), "cls", "left").filter(still).select(*right.columns)
    rest = written(rest, "rest")
    return best if rest.isEmpty() else best.unionByName(_in_lists(left, rest, tasks))


def nearest_in_box(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_cls, right_cls, dist): for each right class the nearest left one of its box whose code is similar and that isn't too far."""
    count = lambda d, name: d.groupBy("box").agg(F.count("*").alias(name))
    many = count(left, "a").join(count(right, "b"), "box").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, many // FEW) if many > FEW else 0
    found = _closest_first(left, right, tasks) if tasks else _in_lists(left, right)
    best = found.groupBy("right_cls").agg(F.min("_near").alias("_near"))
    return best.select("_near.left_cls", "right_cls", "_near.dist")


def _unmatched(left: DataFrame, right: DataFrame, above: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(left_id, right_id) of one level, and what has no partner of both sides."""
    left, right = plain(left), plain(right)
    boxes = above.select(F.col("left_id").alias("parent"), F.col("right_id").alias("box"))
    left, right = left.join(boxes, "parent", "left"), right.withColumn("box", F.col("parent"))
    inside = lambda rows: rows.filter(F.col("box").isNotNull())
    same = identical(inside(left), inside(right), "box", *_KEYS)
    # all that is left of both sides, also where the container has no match
    rest_l, rest_r = written(_without(left, same, "left"), "rest"), written(_without(right, same, "right"), "rest")
    similar = written(walk(coded(inside(rest_l)), coded(inside(rest_r)), ("box", *_KEYS), nearest_in_box).select(*_IDS), "similar")
    rest_l, rest_r = _without(rest_l, similar, "left"), _without(rest_r, similar, "right")
    moved = identical(rest_l, rest_r, *_KEYS)
    done = same.unionByName(similar).unionByName(moved)
    return done, _without(rest_l, moved, "left"), _without(rest_r, moved, "right")


def match_level(left: DataFrame, right: DataFrame, above: DataFrame) -> DataFrame:
    """(left_id, right_id) of one level, from the matches of the containers; objects whose container has no match
    wait for the last stage."""
    return _unmatched(left, right, above)[0]


def nested(levels: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(type, left_id, right_id, parent_match) of all levels (type, left, right), outermost first; objects without
    a partner have null on the other side. parent_match: the left container, for right objects without a partner
    the match of theirs, else null."""
    out, above = None, None
    for name, left, right in levels:
        if above is None:
            done = identical(plain(left), plain(right), *_KEYS)
            only_r = _without(right, done, "right")
        else:
            done, _, only_r = _unmatched(left, right, above)
        l = left.select(F.col("id").alias("left_id"), F.col("parent").alias("left_parent")).join(done, "left_id", "left")
        # of a right parent only those ask that have no left one
        r = right.filter(F.col("parent").isNotNull()).select(F.col("id").alias("right_id"), F.col("parent").alias("right_parent"))
        placed = l.filter(F.col("left_parent").isNotNull()).withColumn("right_parent", F.lit(None).cast("long"))
        placed = placed.unionByName(l.filter(F.col("left_parent").isNull()).join(r, "right_id", "left"))
        none = F.lit(None).cast("long")
        alone = only_r.select(none.alias("left_id"), F.col("id").alias("right_id"), none.alias("left_parent"), F.col("parent").alias("right_parent"))
        placed = placed.unionByName(alone)
        if above is not None:
            turned = above.select(F.col("left_id").alias("turned"), F.col("right_id").alias("right_parent"))
            placed = placed.join(turned, "right_parent", "left")
        else:
            placed = placed.withColumn("turned", none)
        own = placed.select(F.lit(name).alias("type"), *_IDS, F.coalesce("left_parent", "turned").alias("parent_match"))
        out = own if out is None else out.unionByName(own)
        above = done
    return out


def differences(found: DataFrame, levels: list[str]) -> DataFrame:
    """Adds differs (no partner) and below (a container differs) to the rows of nested, level by level from the outermost."""
    out, above = None, None
    for name in levels:
        own = found.filter(F.col("type") == name).withColumn("differs", F.col("left_id").isNull() | F.col("right_id").isNull())
        if above is None:
            own = own.withColumn("below", F.lit(False))
        else:
            # a right object whose container has no match is below a difference
            flags = above.filter(F.col("left_id").isNotNull()).select(F.col("left_id").alias("parent_match"), (F.col("differs") | F.col("below")).alias("_below"))
            own = own.join(flags, "parent_match", "left").withColumn("below", F.coalesce("_below", F.lit(True))).select(*found.columns, "differs", "below")
        if name != levels[-1]:  # what the next level asks for; the last one is read once
            own = written(own, "differences")
        out, above = own if out is None else out.unionByName(own), own
    return out
