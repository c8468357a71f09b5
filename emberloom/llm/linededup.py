"""Repeated runs of lines, found by winnowing, as DataFrame expressions only.

Units are lines; a line also ends behind a sentence mark and a space, and a long sentence behind words that end in
``e``, as scraped text has paragraphs as one line and passages are pasted into the middle of them. Where a unit ends
depends on its sentence alone. Units are equal where they are equal but for white space at their ends; those without
words are skipped, wherever they stand. Words are what stands between ASCII white space.

1. Winnowing. Of a unit and the ``AHEAD`` ones behind it, as far as they begin within ``WINDOW`` words, the one with the
   least hash is a window minimum. Its fingerprint hashes it and the ``AHEAD`` units behind it, as far as they begin within
   ``PRINT`` words. A stretch is the least number of units with ``STRETCH`` words or more, from a unit on or up to one; the
   fingerprint of its first window's minimum lies within it, in every copy. So texts without a fingerprint that occurs
   twice have no repeated stretch, and leave here; in the others, only what begins up to ``AHEAD`` units before one goes on.
   Of equal texts only the first takes part; the others go whole, from the first unit with words to the last, which is what
   their stretches would give.
2. Positions. Each stretch there joins the first one that is equal to it, by ``doc_id`` and then position (in the same
   text, too); all behind it are repeats. Positions never meet all others, and none needs to.
3. Extension. Repeated stretches that overlap or touch grow together to runs, which so reach both ways as far as units
   are equal. Then both ends go on by words into the units that differ, as far as these agree with those beside the
   first occurrence of the outermost stretch.
4. Runs of ``MIN_WORDS`` words or more are deleted, and first occurrences stay.

Every passage of which ``STRETCH`` words are whole units and ``MIN_WORDS`` words are in all is found. Hashes of whole
lists of units stand for stretches: 64 bits, so that two of n different ones are taken for equal with a chance of about
n * n / 2**65. The same holds for texts, which are equal where their hashes are.

Defined cases: null text stays null, empty text stays empty, neither has units; a null ``doc_id`` comes before
all others; rows with equal ``doc_id`` and text are one document (each gets the same result); rows with equal
``doc_id`` and other text are ordered by the MD5 of the text; other columns stay as they are, whatever their
names; an empty table gives no rows. Blank units inside a run go with it, and those beside it stay.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberloom.llm import scratch

MIN_WORDS = 30
STRETCH = 20
WINDOW = 8
PRINT = STRETCH - WINDOW
AHEAD = 4
LONG = 120
#: Words of a unit are counted up to here, which no rule tells from more (it is above ``MIN_WORDS``); all bits set.
_CAP = 63
#: Bits for how far before its minimum a window may begin, ``AHEAD`` units at most.
_BACK = AHEAD.bit_length()
_LEAST = -(2**63)
#: Numbers of stretches, which hardly repeat within a file.
_STRETCH = ("s", "k1", "k2", "a1", "a2")
_MARK = "\x01"
_SPACE = " \t\n\x0b\x0c\r"
_ENDS = ("\n", ". ", "! ", "? ")
#: Those that most texts have.
_USUAL = _ENDS[:2]


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is made once, however often ``f`` reads it; plain columns are made again for each reader inside an
    array function."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _replaced(text: Column, old: str, new: str) -> Column:
    """A text with its marks replaced. A replacement compares whole strings at every byte, and so only a text that has the mark
    is given to it, as a search looks at first bytes only."""
    swap = lambda x: F.replace(x, F.lit(old), F.lit(new))
    return swap(text) if old in _USUAL else _let(text, lambda x: F.when(F.contains(x, F.lit(old)), swap(x)).otherwise(x))


def _pieces(text: Column) -> Column:
    """The units, which joined are the text. Plain replacements take a third of a pattern's time, and so only a text that has
    their mark in it is cut by patterns."""
    marked = text
    for end in _ENDS:
        marked = _replaced(marked, end, end + _MARK)
    long = lambda x: F.octet_length(x) > LONG
    finer = lambda xs, cut: F.flatten(F.transform(xs, lambda x: F.when(long(x), cut(x)).otherwise(F.array(x))))
    by_mark = finer(F.split(marked, _MARK, -1), lambda x: F.split(F.replace(x, F.lit("e "), F.lit("e " + _MARK)), _MARK, -1))
    by_pattern = finer(F.split(text, r"(?<=\n)|(?<=[.!?] )", -1), lambda x: F.split(x, "(?<=e )", -1))
    return F.when(F.contains(text, F.lit(_MARK)), by_pattern).otherwise(by_mark)


def _n_words(x: Column) -> Column:
    """Words of a trimmed unit."""
    odd = functools.reduce(operator.or_, [F.contains(x, F.lit(c)) for c in ("  ", *_SPACE[1:])])
    spaces = F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    return F.when(x == "", 0).when(odd, F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))).otherwise(spaces + 1).cast("long")


def _blank(x: Column) -> Column:
    """Whether a unit has no words; trimmed on one side only, as Spark looks at the whole of a string before it trims the other."""
    return F.ltrim(x, F.lit(_SPACE)) == ""


def _doc(docs: DataFrame) -> list[Column]:
    """The columns that tell documents apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("d"), F.xxhash64("text").alias("h")]


def unit_arrays(texts: DataFrame, *by: str) -> DataFrame:
    """``us`` (hashes) and ``ws`` (numbers of words, ``_CAP`` at most) of the units with words of ``text``, in arrays, and ``n``, the
    number of all units, with the columns of ``by``.

    Most texts have single spaces only, and none beside a line end. Cut at line ends put in for the spaces behind marks, their
    units come out trimmed, and their words are their spaces and one; other texts are looked at unit by unit. Arrays that are
    read at several places stand in selects of their own: in one with their readers, each reader would make them again.
    """
    text = F.col("text")
    odd = functools.reduce(operator.or_, [F.contains(text, F.lit(c)) for c in ("  ", "\t", "\x0b", "\x0c", "\r")])
    lines = text
    for end in _ENDS[1:]:
        lines = _replaced(lines, end, end[0] + "\n")
    rows = texts.select(*by, "text", F.split(lines, "\n", -1).alias("lines"), odd.alias("odd"))
    # all but the last have lost a byte, by which the last alone is judged otherwise
    beside = F.exists("lines", lambda x: F.startswith(x, F.lit(" ")) | F.endswith(x, F.lit(" ")))
    odd = F.col("odd") | beside | (F.octet_length(F.element_at("lines", -1)) == LONG)
    rows = rows.select(*by, "text", "lines", odd.alias("odd"))
    finer = lambda x: F.when(F.octet_length(x) >= LONG, F.split(F.replace(x, F.lit("e "), F.lit("e\n")), "\n", -1)).otherwise(F.array(x))
    rows = rows.select(*by, F.when(F.col("odd"), _pieces(text)).otherwise(F.flatten(F.transform("lines", finer))).alias("all"), "odd")
    trimmed = F.when(F.col("odd"), F.transform("all", lambda x: F.btrim(x, F.lit(_SPACE)))).otherwise(F.col("all"))
    rows = rows.select(*by, F.size("all").alias("n"), F.array_remove(trimmed, "").alias("xs"), "odd")
    plain = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    words = F.when(F.col("odd"), F.transform("xs", lambda x: _n_words(x).cast("int"))).otherwise(F.transform("xs", plain))
    rows = rows.select(*by, "n", F.transform("xs", lambda x: F.xxhash64(x)).alias("us"), words.alias("ws"))
    capped = F.transform("ws", lambda w: F.least(w, F.lit(_CAP)))
    return rows.select(*by, "n", "us", F.when(F.array_max("ws") > _CAP, capped).otherwise(F.col("ws")).alias("ws"))


def _within(units: list[Column], words: int) -> list[Column]:
    """Whether each of these units begins within ``words`` words of the first; a unit's last bits are its words."""
    sums = itertools.accumulate([F.coalesce(u.bitwiseAND(F.lit(_CAP)), F.lit(0)) for u in units[:-1]], operator.add)
    return [F.lit(True), *(x < words for x in sums)]


def _least(units: list[Column]) -> Column:
    """The place of the least hash in the window from the first of these units on; the last bits give way to the place."""
    marked = [F.when(near, u.bitwiseAND(F.lit(~_CAP)) + F.lit(k)) for k, (u, near) in enumerate(zip(units, _within(units, WINDOW), strict=True))]
    return F.least(*marked).bitwiseAND(F.lit(_CAP)).cast("int")


def fingerprints(texts: DataFrame, *by: str) -> DataFrame:
    """``f`` of every window minimum, ``k``, its place among the units with words, and ``i``, where the first window with this
    minimum begins, with the columns of ``by``."""
    return prints_of(unit_arrays(texts, *by), *by)


def prints_of(arrays: DataFrame, *by: str) -> DataFrame:
    """:func:`fingerprints` of what :func:`unit_arrays` gives.

    A row for each unit reads those around it from the array, in compiled code, where array functions are interpreted unit by
    unit. Windows' ends never go back, so a minimum that the window before had too is given out once. ``stack`` makes its
    columns once, where filters and columns above would move down and make them again for each reader; places in the array
    may be read again.
    """
    at = lambda k: F.get("us", k).bitwiseAND(F.lit(~_CAP)) + F.get("ws", k)  # noqa: E731  hash and words in one number
    rows = arrays.select(*by, "us", "ws").where(F.size("us") > 0)
    rows = rows.select(*by, "us", "ws", F.explode(F.sequence(F.lit(0), F.size("us") - 1)).alias("i"))
    u = [F.col(f"u{k}") for k in range(AHEAD + 1)]
    rows = rows.select(*by, "us", "ws", "i", at(F.col("i") - 1).alias("b"), *(at(F.col("i") + k).alias(f"u{k}") for k in range(AHEAD + 1)))
    rows = rows.select(*by, "us", "ws", "i", F.stack(F.lit(1), _least(u), _least([F.col("b"), *u[:AHEAD]])).alias("k", "was"))
    rows = rows.where("i = 0 or was <> k + 1").select(*by, "us", "ws", "i", (F.col("i") + F.col("k")).alias("k"))
    v = [F.col(f"v{j}") for j in range(AHEAD + 1)]
    rows = rows.select(*by, "i", "k", *(at(F.col("k") + j).alias(f"v{j}") for j in range(AHEAD + 1)))
    near = _within(v, PRINT)
    whole = functools.reduce(operator.and_, [~x | c.isNotNull() for c, x in zip(v, near, strict=True)])
    # null where the text ends within the fingerprint
    f = F.when(whole, F.xxhash64(*(F.when(x, c) for c, x in zip(v, near, strict=True))))
    return rows.select(*by, F.stack(F.lit(1), f, F.col("k"), F.col("i")).alias("f", "k", "i")).where("f is not null")


def stretches(texts: DataFrame) -> DataFrame:
    """``doc`` and each stretch from a unit on and up to one, once, whose first window has its minimum among ``hits``: ``s``
    (hash), ``k1`` and ``k2``, the places of its first and last unit among those with words, and ``a1`` and ``a2``, the words
    before it and up to its end. ``texts`` has ``doc``, ``hits`` (see :func:`repeated_texts`), ``us`` and ``ws``.

    The least stretch from unit ``i`` on ends at some unit ``j``, that from the next unit on at some ``j2``. Those that
    begin with ``i`` and are the least up to their last unit end from ``j`` on, before ``j2`` or at the end of the text.
    A row for each stretch reads the arrays by place, in compiled code.
    """
    last = lambda x: F.shiftright(x, _BACK).cast("int")
    windows = lambda x: F.sequence(last(x) - x.bitwiseAND(F.lit(2**_BACK - 1)).cast("int"), last(x))
    starts = F.array_distinct(F.flatten(F.transform("hits", windows)))
    # the unit of each word, and the first word of each unit
    unit_of = F.flatten(F.transform("ws", lambda w, i: F.array_repeat(i, w)))
    rows = texts.select("doc", "us", "ws", starts.alias("starts"), unit_of.alias("unit_of"))
    begins = F.filter(F.sequence(F.lit(0), F.size("unit_of") - 1), lambda w: ~F.get("unit_of", w).eqNullSafe(F.get("unit_of", w - 1)))
    rows = rows.select("doc", "us", "ws", "starts", "unit_of", begins.alias("begins"))
    # an outer one brings no filter that would make the starts again
    rows = rows.select("doc", "us", "ws", "unit_of", "begins", F.explode_outer("starts").alias("k1"))
    end_of = lambda i: F.get("unit_of", F.get("begins", i) + (STRETCH - 1))
    least, following = end_of(F.col("k1")), F.coalesce(end_of(F.col("k1") + 1), F.size("us"))
    rows = rows.select("*", F.coalesce(least, F.lit(-1)).alias("least"), following.alias("following")).where("least >= 0")
    rows = rows.select("doc", "us", "ws", "begins", "k1", F.explode(F.sequence("least", F.greatest("least", F.col("following") - 1))).alias("k2"))
    s = F.xxhash64(F.slice("us", F.col("k1") + 1, F.col("k2") - F.col("k1") + 1))
    return rows.select("doc", s.alias("s"), "k1", "k2", F.get("begins", "k1").alias("a1"), (F.get("begins", "k2") + F.get("ws", "k2")).alias("a2"))


def _agreeing(x: str, y: str, last: bool) -> Column:
    """How many words of two units agree, from their ends or beginnings on."""
    words = [F.split(F.coalesce(F.col(c), F.lit("")), r"[\x20\x09-\x0D]+") for c in (x, y)]
    a, b = (F.reverse(w) if last else w for w in words)
    same = F.zip_with(a, b, lambda i, j: F.coalesce((i == j) & (i != ""), F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("long")


def _place(doc: Column, k: Column) -> Column:
    """A document's number and a place in it as one number, in their order; numbers of rows make cheap aggregates."""
    return F.shiftleft(doc, 31) + k


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``doc``, their number in this order, from 0 on. The driver gets a number of rows for each file."""
    rows = scratch.stash(rows.orderBy(*order).withColumn("doc", F.monotonically_increasing_id()), "ids")
    part = F.shiftrightunsigned("doc", 33)
    sizes = {r.part: r.n for r in rows.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n")).collect()}
    before = [0, *itertools.accumulate(sizes.get(p, 0) for p in range(max(sizes, default=0)))]
    out = rows.withColumn("doc", F.get(F.array(*(F.lit(n).cast("long") for n in before)), part.cast("int")) + F.col("doc").bitwiseAND(F.lit(2**33 - 1)))
    out._stash_path = rows._stash_path
    return out


def repeated_texts(cut: DataFrame, firsts: DataFrame) -> DataFrame:
    """Of the texts (``cut`` has their arrays, by ``d`` and ``h``) with a fingerprint that occurs at two places of different
    texts or of one: ``h``, ``d`` and ``doc``, the number of its first document in the order of ``doc_id`` and the MD5 of the text, and
    ``hits``, the places of those fingerprints, and in the last ``_BACK`` bits how many units before them the first window with
    this minimum begins; so no other unit begins a repeated stretch. Copies count as one text here."""
    prints = scratch.stash(prints_of(cut, "h"), "prints", plain=("f", "k", "i"))
    place = F.xxhash64("h", "k")
    again = prints.groupBy("f").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("f")
    again = scratch.stash(again, "again", plain=("f",))
    hit = F.shiftleft(F.col("k").cast("long"), _BACK) + F.col("k") - F.col("i")
    # tables written at once: nothing above an exchange then keeps Spark from splitting the hot keys of a join
    some = scratch.stash(prints.join(again.hint("shuffle_hash"), "f").groupBy("h").agg(F.collect_set(hit).alias("hits")), "some")
    ids = _numbered(some.join(firsts.hint("merge"), "h"), "d", "m", "h")
    for table in (prints, again, some):
        scratch.drop(table)
    return ids


def _beside(known: DataFrame, ids: DataFrame, asked: DataFrame) -> DataFrame:
    """For each unit with words asked for, by its place ``k`` among them in text ``doc``: ``p``, its place among all units,
    and ``x``, the one before (``ahead``) or behind it."""
    places = asked.distinct().groupBy("doc").agg(F.collect_list(F.struct("k", "ahead")).alias("places"))
    places = scratch.stash(ids.select("d", "h", "doc").join(places.hint("merge"), "doc"), "places")
    rows = known.join(places.hint("shuffle_hash"), ["d", "h"]).select("doc", "places", _pieces(F.col("text")).alias("all"))
    full = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda p: ~_blank(F.get("all", p)))
    rows = rows.select("doc", "places", "all", full.alias("full"))

    def unit(y: Column) -> Column:
        beside = F.get("full", F.when(y["ahead"], y["k"] - 1).otherwise(y["k"] + 1))
        x = F.btrim(F.get("all", beside), F.lit(_SPACE))
        return F.struct(y["k"].alias("k"), y["ahead"].alias("ahead"), F.get("full", y["k"]).alias("p"), x.alias("x"))

    found = rows.select("doc", F.explode(F.transform("places", unit)).alias("y"))
    return found.select("doc", "y.*").dropDuplicates(["doc", "k", "ahead"])


def repeated_runs(known: DataFrame, cut: DataFrame, firsts: DataFrame) -> DataFrame:
    """``d``, ``h`` and ``runs``: what to delete of the first documents of texts that have some, as first and last place of units
    and words of the units before and behind."""
    ids = repeated_texts(cut, firsts)
    near = cut.select("d", "h", "us", "ws").join(ids.select("d", "h", "doc", "hits").hint("shuffle_hash"), ["d", "h"])
    parts = stretches(near).select("s", "doc", "k1", "k2", "a1", "a2")
    parts = scratch.stash(parts, "stretches", plain=_STRETCH)
    place = _place(F.col("doc"), F.col("k1"))
    keys = parts.groupBy("s").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    keys = scratch.stash(keys.select("s", "first"), "keys", plain=("s", "first"))
    met = scratch.stash(parts.join(keys.hint("shuffle_hash"), "s").where(place > F.col("first")).drop("s"), "met", plain=(*_STRETCH, "first"))
    scratch.drop(parts), scratch.drop(keys)
    by = Window.partitionBy("doc").orderBy("k1", "k2")
    ended = F.max("k2").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = met.withColumn("new", F.coalesce((F.col("k1") > ended + 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    pair = lambda x, y: _place(F.col(x).cast("long"), F.col(y))
    left, right = F.min_by("first", pair("k1", "k2")), F.max_by(F.col("first") + F.col("k2") - F.col("k1"), pair("k2", "k1"))
    words = (F.max("a2") - F.min("a1")).cast("long")
    runs = rows.groupBy("doc", "run").agg(F.min("k1").alias("begins"), F.max("k2").alias("ends"), words.alias("words"), left.alias("l"), right.alias("g"))
    number, at = lambda x: F.shiftright(x, 31), lambda x: F.col(x).bitwiseAND(F.lit(2**31 - 1)).cast("int")
    runs = runs.select("doc", "begins", "ends", "words", number("l").alias("ld"), at("l").alias("lk"), number("g").alias("gd"), at("g").alias("gk"))
    runs = scratch.stash(runs, "runs")
    sides = {"w": ("doc", "begins", True), "x": ("ld", "lk", True), "y": ("doc", "ends", False), "z": ("gd", "gk", False)}
    asked = [runs.select(F.col(d).alias("doc"), F.col(k).alias("k"), F.lit(ahead).alias("ahead")) for d, k, ahead in sides.values()]
    answers = scratch.stash(_beside(known, ids, functools.reduce(DataFrame.union, asked)), "beside")
    for name, (d, k, ahead) in sides.items():
        own = answers.where(F.col("ahead") == ahead).select(F.col("doc").alias(d), F.col("k").alias(k), F.col("x").alias(name), F.col("p").alias(f"{name}_p"))
        runs = runs.join(own.hint("shuffle_hash"), [d, k], "left")
    runs = runs.withColumns({"before": _agreeing("w", "x", True), "behind": _agreeing("y", "z", False), "first": F.col("w_p"), "last": F.col("y_p")})
    runs = runs.where(F.col("words") + F.col("before") + F.col("behind") >= MIN_WORDS)
    made = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("first", "last", "before", "behind"))).alias("runs"))
    made = scratch.stash(made.join(ids.select("d", "h", "doc").hint("merge"), "doc").select("d", "h", "runs"), "deleted")
    for table in (met, ids, answers):
        scratch.drop(table)
    return made


def verdicts(docs: DataFrame) -> DataFrame:
    """For each document with a text: ``d``, ``h``, ``n`` (units), ``copy`` (whether an earlier one has its text) and ``runs``, if it
    has some and is no copy."""
    known = docs.where(F.col("text") != "").select(*_doc(docs), "text")
    # the first 15 digits of the MD5, in its order
    cut = known.select("d", "h", F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("m"), "text")
    cut = scratch.stash(unit_arrays(cut, "d", "h", "m"), "cut", plain=("d", "h", "m", "us.list.element"))
    firsts = scratch.stash(cut.groupBy("h").agg(F.min("d").alias("d"), F.min("m").alias("m")), "firsts")
    made = repeated_runs(known, cut, firsts)
    copies = cut.select("d", "h", "n").join(firsts.select("h", F.col("d").alias("d0")).hint("merge"), "h")
    each = copies.groupBy("d", "h").agg(F.max("n").alias("n"), F.max(F.col("d") > F.col("d0")).alias("copy"))
    out = scratch.stash(each.join(made.hint("merge"), ["d", "h"], "left"), "verdicts")
    for table in (cut, firsts, made):
        scratch.drop(table)
    return out


def _without(text: Column, k: Column) -> Column:
    """A text without its first ``k`` words and the white space before them. A split with a limit finds where they end,
    as a pattern that repeats a word many times would exhaust the stack."""

    def cut(whole: Column) -> Column:
        first = F.when(whole.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
        return _let(F.element_at(F.split(whole, r"[\x20\x09-\x0D]+", (k + 1 + first).cast("int")), -1), lambda rest: behind(whole, rest))

    def behind(whole: Column, rest: Column) -> Column:
        gone = F.left(whole, F.length(whole) - F.length(rest))
        return _let(gone, lambda x: _let(F.concat(F.substring(x, F.length(F.rtrim(x, F.lit(_SPACE))) + 1, F.length(x)), rest), lambda out: F.left(out, F.length(out) - 1)))

    return F.when(k == 0, text).otherwise(_let(F.concat(text, F.lit(" ")), cut))


def _kept() -> Column:
    """What stays between the ``runs``: the units of ``all`` there, without the words that the runs before and behind go on
    into. The end of the last unit is one more run."""
    size, none = F.size("all"), F.lit(0).cast("long")
    end = F.struct(size.alias("first"), size.alias("last"), none.alias("before"), none.alias("behind"))

    def gap(x: Column, i: Column) -> Column:
        was = F.get("runs", i - 1)
        start = F.coalesce(was["last"] + 1, F.lit(0))
        units = F.array_join(F.slice("all", start + 1, x["first"] - start), "")
        onward = _let(units, lambda u: _without(u, F.coalesce(was["behind"], none)))
        return _let(onward, lambda u: F.when(x["before"] == 0, u).otherwise(F.reverse(_let(F.reverse(u), lambda v: _without(v, x["before"])))))

    return F.transform(F.concat("runs", F.array(end)), gap)


def _whole() -> Column:
    """The one run of a copy: all from the first unit with words to the last, if it has ``MIN_WORDS`` words."""
    blank = F.transform("all", _blank)
    first, none = F.array_position(blank, False), F.lit(0).cast("long")
    last = F.size("all") - F.array_position(F.reverse(blank), False)
    run = F.struct((first - 1).cast("int").alias("first"), last.cast("int").alias("last"), none.alias("before"), none.alias("behind"))
    return F.when(F.regexp_count(F.col("row.text"), F.lit(r"[^\x20\x09-\x0D]+")) >= MIN_WORDS, F.array(run))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The input with ``text`` cleaned, and ``n_lines`` (units), ``n_removed`` (whole ones) behind all its columns."""
    found = verdicts(docs)
    d, h = _doc(docs)
    joined = docs.select(F.struct(*docs.columns).alias("row"), d, h).join(found.hint("shuffle_hash"), ["d", "h"], "left")
    text = F.col("row.text")
    cut = joined.select("row", "n", "copy", "runs", F.when(F.col("copy") | F.col("runs").isNotNull(), _pieces(text)).alias("all"))
    cut = cut.select("row", "n", "all", F.when(F.col("copy"), _whole()).otherwise(F.col("runs")).alias("runs"))
    gone = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    sizes = [F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0).cast("long")).alias("n_removed")]
    clean = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(_kept(), ""))
    columns = [clean.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return cut.select(*columns, *sizes)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: units, units removed, and length and MD5 of the text that stays."""
    done = deduplicate(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


#: The same result without fingerprints: every stretch of every text, as the list of its units.
DIGEST_SQL = r"""
with docs as (select distinct doc_id as d, text as t, md5(text) as h from documents where length(text) > 0),
sentence as (
  select d, h, unnest(range(len(x))) as i, unnest(x) as s
  from (select d, h, string_split(regexp_replace(t, '(\n|[.!?] )', '\1' || chr(1), 'g'), chr(1)) as x from docs)),
part as (
  select d, h, i, unnest(range(len(x))) as j, unnest(x) as raw
  from (select *, string_split(case when strlen(s) > 120 then replace(s, 'e ', 'e ' || chr(1)) else s end, chr(1)) as x from sentence)),
piece as (select d, h, raw, row_number() over (partition by d, h order by i, j) - 1 as p from part),
word as (select *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as x from piece),
unit as (
  select d, h, p, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as ws, len(ws) as w,
    row_number() over (partition by d, h order by p) as k, sum(w) over (partition by d, h order by p) as a, a - w as b
  from word where x <> ''),
place as (
  select *, lag(ws) over o as before, lead(ws) over o as behind from unit window o as (partition by d, h order by p)),
stretch as (
  select d, h, true as onward, k as k1, p as p1, b as b1, max(k) over f as k2, max(p) over f as p2, max(a) over f as a2,
    md5(cast(list(x) over f as varchar)) as s, before as beside
  from place window f as (partition by d, h order by b range between 0 preceding and 19 following)
  union all
  select d, h, false, min(k) over f, min(p) over f, min(b) over f, k, p, a, md5(cast(list(x) over f as varchar)), behind
  from place window f as (partition by d, h order by a range between 19 preceding and 0 following)),
enough as (select * from stretch where a2 - b1 >= 20),
earliest as (select onward, s, arg_min(struct_pack(v := beside), (coalesce(d, -9223372036854775808), h, k1)).v as beside0,
    min((coalesce(d, -9223372036854775808), h, k1)) as began from enough group by onward, s having count(*) > 1),
met as (
  select l.*, list_reverse(beside) as r, list_reverse(beside0) as r0, beside0
  from enough l join earliest f on f.s = l.s and f.onward = l.onward and (coalesce(d, -9223372036854775808), h, k1) <> began),
counted as (
  select *, coalesce(len(list_filter(range(1, least(len(beside), len(beside0)) + 1), lambda i:
    case when onward then r[1:i] = r0[1:i] else beside[1:i] = beside0[1:i] end)), 0) as more from met),
marked as (
  select *, case when k1 > max(k2) over (partition by d, h order by k1, k2, onward rows between unbounded preceding and 1 preceding) + 1
    then 1 else 0 end as fresh from counted),
grown as (select *, sum(fresh) over (partition by d, h order by k1, k2, onward rows unbounded preceding) as run from marked),
run as (
  select d, h, run, min(p1) as low, max(p2) as high, arg_min(more, k1) filter (where onward) as before,
    arg_max(more, k2) filter (where not onward) as behind, max(a2) - min(b1) as n
  from grown group by d, h, run having n + before + behind >= 30),
numbered as (
  select *, row_number() over (partition by d, h order by low) as n_run from run),
kept as (
  select p.d, p.h, p.p, p.raw, (select count(*) from run r where r.d is not distinct from p.d and r.h = p.h and r.low <= p.p) as gap,
    exists (select 1 from run r where r.d is not distinct from p.d and r.h = p.h and p.p between r.low and r.high) as gone
  from piece p),
gap as (select d, h, gap, coalesce(string_agg(raw, '' order by p) filter (where not gone), '') as t, count(*) as n, count(*) filter (where gone) as m
  from kept group by d, h, gap),
cut as (
  select g.d, g.h, g.gap, g.n, g.m, case when coalesce(r.behind, 0) = 0 then g.t
    else regexp_replace(g.t, '^(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){' || r.behind || '}', '') end as t, coalesce(q.before, 0) as before
  from gap g left join numbered r on r.d is not distinct from g.d and r.h = g.h and r.n_run = g.gap
  left join numbered q on q.d is not distinct from g.d and q.h = g.h and q.n_run = g.gap + 1),
clean as (
  select d, h, sum(n) as n_lines, sum(m) as n_removed, string_agg(case when before = 0 then t
    else regexp_replace(t, '[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,' || (before - 1) || '}[\x20\x09-\x0D]*$', '') end, '' order by gap) as t
  from cut group by d, h)
select o.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  length(coalesce(c.t, o.text)) as n_chars, md5(coalesce(c.t, o.text)) as text_md5
from documents o left join clean c on c.d is not distinct from o.doc_id and c.h = md5(o.text)
"""
