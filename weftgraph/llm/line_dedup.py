"""Line dedup by a segment-partition edit join.

A line is dropped when an earlier line of the corpus is the same or within
``edits`` single-character edits; earlier means a smaller document id, then a
smaller line number. Lines of fewer than ``min_chars`` characters stay.

Same lines are combined on the map side first, so that a line that fills a
third of the corpus costs no more than any other; the first occurrence stands
for all and gets a number. Each remaining line is cut into ``edits`` + 1
segments; within ``edits`` edits at least one segment stays whole and can only
have shifted by a little. Segments go into an index by (length of the line,
number of the segment, content); every line probes it with the substrings at
the places a segment can have moved to, for its own and the shorter lengths.
What meets is verified by a banded bit-parallel edit distance: an automaton
whose states (diagonals of the band, by number of edits) are the bits of one
long, advanced by shifts and masks for each character.

Index and probes carry hashes and numbers, not text. Keys are counted first,
combined on the map side; only lines with a key that another line shares (few,
in ordinary text) are looked at again, and only their text is fetched. These
joins hash the smaller side by partition, so that they go the same way, without
a broadcast or a sort, at every size.

A line needs one earlier line within the limit to go, so it is compared with
the earliest line of each key first. Lines that this leaves open meet the
earlier lines of a key that agree with them in the counts of a group of
letters as well: an edit changes at most two counts, so of two groups for each
edit and one more at least one is as it was. That parts the lines of a crowded
key, by what else they hold, among tasks.

DataFrame expressions only.

Defined results: a null text has no lines and stays null; an empty text stays
empty; rows that repeat an id share the line numbers that stay; a null id comes
last, after all others (ids lie below 2^63 - 1); ids that are not integers are
refused with a ``TypeError``; an empty table gives an empty result. A line
within the limits of a dropped line is dropped too. Work on a text grows with
its length, however many lines it has. Columns of the input stay as they are
but for the text; an input column named as ``dropped_col`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from weftgraph.plans.durable import Scratch, durable

EDITS, MIN_CHARS = 2, 24
# Letters whose counts bound the distance of two lines from below, in the order of their frequency.
COUNTED = ("e", "n", "t", "a", "i", "o", "r", " ", "s", "h", "d", "l", "u", "c", "m", "g", "f", "p", "b", "w")
_LAST = (1 << 63) - 1
INDEX, PROBE = 0, 1


def segment(length: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """(start, length) of segment ``i`` of the edits + 1 even segments of a line; the last ones are longer by one."""
    parts = edits + 1
    longer = length % parts
    short = F.call_function("div", length, F.lit(parts)).cast("int")
    # ``longer`` segments at the end have one character more
    return short * i + F.greatest(longer - (parts - i), F.lit(0)), short + (i >= parts - longer).cast("int")


def places_to_look(edits: int) -> list[tuple[int, int, int, int]]:
    """(role, length less, segment, shift) of a line's keys: its own segments, which are index and probe at once, and probes.

    A probe reaches index lines of its own and the shorter lengths. From the left
    at most ``i`` edits can have moved segment ``i``, from the right ``edits - i``.
    """
    own = [(INDEX, 0, i, 0) for i in range(edits + 1)]
    return own + [(PROBE, less, i, shift) for less in range(edits + 1) for i in range(edits + 1) for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1) if less or shift]


def keyed(lines: DataFrame, edits: int) -> DataFrame:
    """id, role and key for lines (id, line), for each place to look that lies inside the line.

    Characters are cut out of UTF-16, where each has its place, unless one of them takes two units.
    """
    places = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("role", "less", "i", "shift"), p))) for p in places_to_look(edits)))
    marked = lines.select("id", "line", F.length("line").alias("length"), F.encode("line", "UTF-16BE").alias("units"))
    at = marked.select("id", "line", "length", "units", F.explode(places).alias("at"))
    length = F.col("length") - F.col("at.less")
    start, n = segment(length, F.col("at.i"), edits)
    placed = at.select("id", "line", "units", "length", "at", length.alias("of"), (start + F.col("at.shift")).alias("start"), n.alias("n")).where("start >= 0 and start + n <= length")
    cut = F.when(F.octet_length("units") == 2 * F.col("length"), F.substring("units", F.col("start") * 2 + 1, F.col("n") * 2)).otherwise(F.encode(F.substring("line", F.col("start") + 1, F.col("n")), "UTF-16BE"))
    return placed.select("id", F.col("at.role").cast("byte").alias("role"), F.xxhash64("of", "at.i", cut).alias("key"))


def groups_of(edits: int) -> int:
    """Groups of letters: more than the counts that ``edits`` edits can change, so that one group is as it was."""
    return max(3, 2 * edits + 1)


def letter_counts(line: Column, edits: int) -> Column:
    """Counts of the letters, modulo 256, in the bytes of longs; a long is a group of letters, dealt in turn."""
    n, groups = F.length(line), groups_of(edits)
    count = [(n - F.length(F.replace(line, F.lit(c)))).cast("long").bitwiseAND(255) for c in COUNTED]
    return F.array(*(reduce(Column.bitwiseOR, (F.shiftleft(c, 8 * k) for k, c in enumerate(count[g::groups]))) for g in range(groups)))


def counts_apart(a: Column, b: Column, edits: int) -> Column:
    """How far two counts are apart at least, summed over the letters; every edit adds at most two."""

    def around(i: int) -> Column:  # modulo 256, the shorter way
        at, byte = divmod(i, groups_of(edits))[::-1]
        of = lambda x: F.shiftright(F.get(x, F.lit(at)), 8 * byte).bitwiseAND(255)
        d = F.abs(of(a) - of(b))
        return F.least(d, 256 - d)

    return reduce(Column.__add__, map(around, range(len(COUNTED))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _trimmed(pair: Column) -> Column:
    """The pair without most of what its strings begin or end with alike; that leaves their distance as it is."""

    def cut(part: int, front: bool, p: Column) -> Column:
        a, b = p["a"], p["b"]
        na, nb = F.length(a), F.length(b)
        k = F.call_function("div", F.least(na, nb), F.lit(part)).cast("int")
        if front:
            same = F.substring(a, 1, k) == F.substring(b, 1, k)
            rest = F.struct(F.substring(a, k + 1, na).alias("a"), F.substring(b, k + 1, nb).alias("b"))
        else:
            same = F.substring(a, na - k + 1, k) == F.substring(b, nb - k + 1, k)
            rest = F.struct(F.substring(a, 1, na - k).alias("a"), F.substring(b, 1, nb - k).alias("b"))
        return F.when(same, rest).otherwise(p)

    for front in (True, False):
        for part in (2, 4, 8, 16):
            pair = _let(pair, partial(cut, part, front))
    return pair


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` (up to 4) edits of each other."""
    if not 0 <= edits <= 4:
        raise ValueError("edits must be from 0 to 4")
    width = 2 * edits + 1  # diagonals; bit d of a level: the state on diagonal d - edits of the band
    lane = width + 1  # a spare bit keeps shifts from running into the next level
    lanes = [1 << lane * e for e in range(edits + 1)]
    all_bits = sum(((1 << width) - 1) * x for x in lanes)
    upper = all_bits & ~((1 << width) - 1)  # all levels but the lowest

    def long(x: int) -> Column:
        return F.lit(x).cast("long")

    def closed(state: Column) -> Column:
        """With characters of ``a`` left out: each moves one diagonal and one level up."""
        out, mask = state, upper
        for k in range(1, edits + 1):
            out = out.bitwiseOR(F.shiftleft(state, (lane + 1) * k).bitwiseAND(long(mask)))
            mask = mask << (lane + 1) & upper
        return out

    def step(at: Column, j: Column) -> Column:  # j: place in b, from 0; the characters travel along, so they are split once
        state = at["state"]
        match = long(0)
        for d in range(width):
            same = F.get(at["a"], j + d) == F.get(at["b"], j)  # null beyond the end
            match = match.bitwiseOR(F.when(same, long(sum(x << d for x in lanes))).otherwise(long(0)))
        kept = closed(state).bitwiseAND(match)
        up = F.shiftleft(closed(state), lane)  # another character in its place, or one of ``b`` added
        new = F.struct(kept.bitwiseOR(up.bitwiseAND(long(upper))).bitwiseOR(F.shiftright(up, 1).bitwiseAND(long(upper))).alias("state"), at["a"].alias("a"), at["b"].alias("b"), at["goal"].alias("goal"))
        return F.when(state == 0, at).otherwise(new)  # too many edits already: nothing to work out

    def run(pair: Column) -> Column:
        n, m = F.length(pair["a"]), F.length(pair["b"])
        chars = F.concat(F.array_repeat(F.lit(""), edits), F.split(pair["a"], ""))
        first = F.struct(long(1 << edits).alias("state"), chars.alias("a"), F.split(pair["b"], "").alias("b"), (n - m + edits).alias("goal"))
        steps = F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))

        def reached(at: Column) -> Column:
            end = closed(at["state"])
            return reduce(Column.__or__, (F.call_function("shiftright", end, at["goal"] + lane * e).bitwiseAND(1) == 1 for e in range(edits + 1)))

        return F.aggregate(steps, first, step, reached)

    return F.when(F.abs(F.length(a) - F.length(b)) > edits, False).otherwise(_let(_trimmed(F.struct(a.alias("a"), b.alias("b"))), run))


def _lines(text: str | Column) -> Column:
    return F.split(text, "\n")


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))


def first_lines(texts: DataFrame, min_chars: int) -> DataFrame:
    """doc, place, line: every different line where it occurs first, from (doc, text)."""
    seen = texts.select("doc", F.posexplode(_lines("text")).alias("place", "line")).where(F.length("line") >= min_chars)
    # document and line number as one integer of up to 38 digits: its minimum is kept in place while rows are combined
    shift = F.lit(1 << 31).cast("decimal(11,0)")
    at = (F.col("doc").cast("decimal(20,0)") * shift + F.col("place").cast("decimal(11,0)")).cast("decimal(38,0)")
    first = seen.groupBy("line").agg(F.min(at).alias("at"))
    place = F.expr("pmod(at, 2147483648BD)")
    return first.select(((F.col("at") - place) / shift).cast("long").alias("doc"), place.cast("int").alias("place"), "line")


def meetings(lines: DataFrame, edits: int, durable: Scratch) -> DataFrame:
    """key, role, id: the lines (id, line) of every key that an index line and another line share."""
    counted = keyed(lines, edits).groupBy("key").agg(F.count("*").alias("n"), F.min("role").alias("role"))
    shared = durable(counted.where((F.col("n") > 1) & (F.col("role") == INDEX)).select("key"), "shared-keys")
    return keyed(lines, edits).join(shared.hint("shuffle_hash"), "key", "left_semi").select("key", "role", "id")


def late_lines(lines: DataFrame, edits: int, durable: Scratch) -> DataFrame:
    """id of the ``lines`` (id, doc, place, line) with an earlier line within ``edits`` edits."""
    met = durable(meetings(lines, edits, durable), "meetings")
    texts = lines.join(met.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
    texts = durable(texts.select("id", F.struct("doc", "place").alias("at"), "line", letter_counts(F.col("line"), edits).alias("counts")), "met-lines")

    near = (counts_apart(F.col("counts_a"), F.col("counts_b"), edits) <= 2 * edits) & within_edits(F.col("line_a"), F.col("line_b"), edits)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs of line numbers (a, b) the b that are within the limit of their a."""
        side = lambda x: texts.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"), F.col("counts").alias(f"counts_{x}"))
        both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
        return both.where(near).select(F.col("b").alias("id")).distinct()

    rows = durable(met.join(texts.select("id", "at", "counts"), "id"), "met-rows")
    own, every = F.col("role") == INDEX, F.struct("at", "id")
    first = durable(rows.groupBy("key").agg(F.min(F.when(own, every)).alias("index"), F.min(every).alias("any"), F.count("*").alias("n")), "first-of-keys")
    # an index line may meet any line of its key, a probe the index lines
    partner = F.when(own, F.col("any")).otherwise(F.col("index"))
    beside = rows.join(first, "key").select("key", "role", "id", "at", "counts", "n", partner.alias("partner"))
    settled = durable(verified(beside.where(F.col("partner.at") < F.col("at")).select(F.col("partner.id").alias("a"), F.col("id").alias("b"))), "settled")
    open_ = beside.where((F.col("n") > 2) & (F.col("partner.at") < F.col("at"))).join(settled, "id", "left_anti")

    def parted(some: DataFrame, name: str) -> DataFrame:
        """Rows for each group of letters, to meet in one of them."""
        group = F.posexplode("counts").alias("group", "held")
        return some.select("*", group).select("key", "group", "held", F.struct(*(c for c in some.columns if c != "key")).alias(name))

    # every line of a key where one is open: an earlier partner can itself be settled
    around = rows.join(open_.select("key").distinct(), "key", "left_semi")
    both = parted(open_.select("key", "role", "id", "at", "counts", F.col("partner.id").alias("done")), "r").join(parted(around, "g"), ["key", "group", "held"])
    met_too = both.where(((F.col("g.role") == INDEX) | (F.col("r.role") == INDEX)) & (F.col("g.at") < F.col("r.at")) & (F.col("g.id") != F.col("r.done")) & (counts_apart(F.col("g.counts"), F.col("r.counts"), edits) <= 2 * edits))
    more = verified(met_too.select(F.col("g.id").alias("a"), F.col("r.id").alias("b")))
    return settled.unionByName(more)


def staying(texts: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(doc, places): the lines of at least ``min_chars`` characters that stay, from (doc, text)."""
    with Scratch() as scratch:
        lines = scratch(first_lines(texts, min_chars).select(F.monotonically_increasing_id().alias("id"), "doc", "place", "line"), "lines")
        late = scratch(late_lines(lines, edits, scratch), "late-lines")
        left = lines.select("id", "doc", "place").join(late, "id", "left_anti")
        return durable(left.groupBy("doc").agg(F.collect_list("place").alias("places")), "staying")


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", dropped_col: str = "dropped_lines") -> DataFrame:
    """``docs`` with the text that is left, and ``dropped_col``: the numbers (from 0) of the lines that went."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column; its order says which line is earlier")
    keep = staying(docs.select(_doc(id_col).alias("doc"), F.col(text_col).alias("text")), edits, min_chars)
    rest = [c for c in docs.columns if c != dropped_col]
    # one struct, so that no name of the input meets one of ours
    rows = docs.select(_doc(id_col).alias("doc"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"))
    met = rows.join(keep.hint("shuffle_hash"), "doc", "left").withColumn("text", F.col("row").getField(text_col))

    def cut(line: Column) -> Column:  # of the lines of a text, split once: array_except is linear, a search for each line is not
        every = F.sequence(F.lit(0), F.size(line) - 1)
        long = F.filter(every, lambda i: F.length(F.get(line, i)) >= min_chars)
        gone = F.array_except(long, F.coalesce(F.col("places"), F.array().cast("array<int>")))
        return F.struct(line.alias("line"), every.alias("every"), gone.alias("gone"))

    def joined(c: Column) -> Column:
        text = F.when(F.size(c["gone"]) == 0, F.col("text")).otherwise(F.array_join(F.transform(F.array_except(c["every"], c["gone"]), lambda i: F.get(c["line"], i)), "\n"))
        return F.struct(text.alias("text"), c["gone"].alias("gone"))

    none = F.array().cast("array<int>")
    out = met.select("row", F.when(F.col("text").isNotNull(), _let(_let(_lines("text"), cut), joined)).alias("out"))
    return out.select(*((F.col("out.text") if c == text_col else F.col("row").getField(c)).alias(c) for c in rest), F.coalesce("out.gone", none).alias(dropped_col))
