"""Line dedup: an exact set-similarity join of lines in DataFrame operations alone."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Cells of the table of token counts, at any size of the corpus.
CELLS = 1 << 18
#: Steps of a doubling into which counts are put; a class must stay below 128.
STEPS = 3
#: Tokens of a line that look for a centre before the join of all.
PIVOTS = 3
#: Rounds of centres at most; what they leave is joined whole.
ROUNDS = 3
#: Classes that met a centre, at most, of which no more rounds are made: the join can have all their pairs.
FEW = 1000
#: Shares of the tokens that are joined one after the other.
SHARES = 2
#: Bits of a bitmap that the public bitmap functions make, and of all of them together at most.
BITMAP, MOST_BITS = 32768, 1 << 28


def _spaced(text: str) -> Column:
    """Lower case, with a blank for each white space of ASCII but the newline; most texts have none to replace."""
    spaces = "\t\r\f\v"
    out = F.lower(F.col(text))
    for space in spaces:
        out = F.replace(out, F.lit(space), F.lit(" "))
    held = [F.contains(F.col(text), F.lit(space)) for space in spaces]
    return F.when(held[0] | held[1] | held[2] | held[3], out).otherwise(F.lower(F.col(text)))


def _words(line: str) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _tokens(words: str, short: int, value=None) -> Column:
    """The distinct words; of fewer than `short`, their sequence as one token, which no word equals; null for none.

    Where `value` is given, that of each.
    """
    sequence = F.concat(F.lit(" "), F.array_join(words, " "))
    each, whole = (F.transform(words, value), value(sequence)) if value else (F.col(words), sequence)
    return F.when(F.size(words) >= short, F.array_distinct(each)).when(F.size(words) > 0, F.array(whole))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text) of documents with text: th tells rows of one id and different texts apart."""
    text = F.col("text").cast("string")
    return docs.where("text is not null").select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, line) of each line of such rows, spaced."""
    return rows.select("doc_id", "th", F.posexplode(F.split(_spaced("text"), "\n", -1)).alias("line_no", "line"))


def tokens_of(docs: DataFrame, short: int) -> DataFrame:
    """(doc_id, th, line_no, hashes): the hashes of the distinct tokens of each line; null for a line without words."""
    # an array that is used more than once has a projection of its own, which the optimizer keeps; a filter on one
    # would be pushed below it and work it out again, so lines without words stay here
    lines = _lines(_rows(docs)).select("doc_id", "th", "line_no", _words("line").alias("words"))
    return lines.select("doc_id", "th", "line_no", _tokens("words", short, lambda w: F.xxhash64(w)).alias("hashes"))


def rarity(lines: DataFrame) -> list[int]:
    """Classes of token counts, 0 for the rarest, in CELLS cells; lines are those of tokens_of.

    Each token of all lines is counted by itself, once a line. A cell holds the largest count of the tokens that fall
    into it, and that is the class of them all: the k-th most frequent token meets a more frequent one with a chance of
    about k / CELLS, and then comes later than its own count would have it; so do most tokens beyond the CELLS most
    frequent, whose order is only roughly that of rarity. Any one order of all tokens makes
    the prefix filter exact. The driver gets a row for each cell.
    """
    counts = lines.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    cells = counts.groupBy((F.col("h").bitwiseAND(F.lit(CELLS - 1))).cast("int").alias("c")).agg(F.max("n").alias("n"))
    out = [0] * CELLS
    for c, k in cells.select("c", F.floor(F.log2("n") * STEPS).cast("int")).collect():
        out[c] = min(k, 127)
    return out


def signed_lines(lines: DataFrame, part: int, whole: int) -> DataFrame:
    """(s, t, doc_id, th, line_no, n, g0, g1, prefix) of each line of tokens_of that has words.

    s and t name the set of n tokens; prefix has those, rare ones first, of which two matching sets share one, as
    32-bit hashes; g0 and g1 are parities of the tokens' hashes, 128 in all: each token that only one of two sets has
    changes one of them.
    """
    table = F.split(F.lit(",".join(map(str, rarity(lines)))), ",").cast("array<tinyint>")

    def key(h: Column) -> Column:
        place = F.get(table, h.bitwiseAND(F.lit(CELLS - 1)).cast("int")).cast("long")
        return F.coalesce(F.shiftleft(place, 56).bitwiseOR(F.shiftrightunsigned(h, 8)), F.lit(0).cast("long"))

    at = ["doc_id", "th", "line_no"]
    keyed = lines.where("hashes is not null").select(*at, F.sort_array(F.transform("hashes", key)).alias("keys"))
    # for each value of the lowest 7 bits, what it changes in g0 and in g1
    bits, none = [1 << k for k in range(63)] + [-(1 << 63)], [0] * 64

    def parity(changes: list[int]) -> Column:
        table = F.array(*[F.lit(c).cast("long") for c in changes])
        return F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.get(table, k.bitwiseAND(F.lit(127)).cast("int"))))

    prefix = F.col("n") - F.ceil(F.col("n") * part / whole).cast("int") + 1
    sized = keyed.withColumn("n", F.size("keys"))
    return sized.select(
        F.xxhash64("keys").alias("s"), F.xxhash64(F.lit(7), "keys", F.lit(9)).alias("t"), "doc_id", "th", "line_no", "n", parity(bits + none).alias("g0"),
        parity(none + bits).alias("g1"), F.transform(F.slice("keys", F.lit(1), prefix), lambda k: F.hash(k)).alias("prefix"),
    )


def _marked(rows: DataFrame, ids: DataFrame, count: int, columns: list[str]) -> DataFrame:
    """Rows with _may: true for all that have an equal one in ids and for few others: bitmaps of hashes, 8 bits for each id and 32 MB at most."""
    bits = max(1, min(MOST_BITS, 8 * count) // BITMAP)
    place = F.pmod(F.xxhash64(*columns), F.lit(bits * BITMAP))
    spots = ids.select(place.alias("p")).select(F.expr(f"p div {BITMAP}").alias("_b"), (F.col("p") % BITMAP).alias("p"))
    maps = spots.groupBy("_b").agg(F.bitmap_construct_agg("p").alias("_map"))
    placed = rows.withColumn("_p", place).withColumn("_b", F.expr(f"_p div {BITMAP}")).withColumn("_p", F.col("_p") % BITMAP)
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_p div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = F.call_function("getbit", byte, (F.col("_p") % 8).cast("int")) == 1
    return placed.join(F.broadcast(maps), "_b", "left").select(*rows.columns, F.coalesce(held, F.lit(False)).alias("_may"))


def _chosen(rows: DataFrame, ids: DataFrame, count: int, columns: list[str]) -> DataFrame:
    """Of rows, all that have an equal one in ids and few others."""
    return _marked(rows, ids, count, columns).where("_may").drop("_may")


def _flagged(rows: DataFrame, ids: DataFrame, columns: list[str], extra: list[str]) -> DataFrame:
    """Rows with the extra columns of the equal row of ids, a written table without repeats; null where there is none.

    Only rows that may have one are shuffled.
    """
    marked = _marked(rows, ids, ids.count(), columns)
    none = marked.where("not _may").select(*rows.columns, *[F.lit(None).cast(ids.schema[c].dataType).alias(c) for c in extra])
    other = ids.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(columns)], *extra)
    same = [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(columns)]
    met = marked.where("_may").join(other, functools.reduce(Column.__and__, same), "left")
    return none.unionByName(met.select(*rows.columns, *extra))


def _may(part: int, whole: int) -> Column:
    """Whether the sizes and the parities of two sets (the second one's columns end in 2) allow the similarity."""
    total = F.col("n") + F.col("n2")
    apart = F.bit_count(F.col("g0").bitwiseXOR(F.col("g02"))) + F.bit_count(F.col("g1").bitwiseXOR(F.col("g12")))
    sizes = F.lit(whole) * F.least("n", "n2") >= F.lit(part) * F.greatest("n", "n2")
    return sizes & (F.lit(whole + part) * apart <= F.lit(whole - part) * total)


def _postings(classes: DataFrame) -> DataFrame:
    """(token, c, u, g0, g1): a row for each prefix token of a class.

    u is n, the number of tokens from this one on, and whether the class is settled, in 32, 31 and 1 bits: the rows are
    most of what is shuffled.
    """
    u = "shiftleft(cast(n as long), 32) | shiftleft(cast(n - pos as long), 1) | if(done, 1L, 0L)"
    posted = classes.select("c", "done", "n", "g0", "g1", F.posexplode("prefix").alias("pos", "token"))
    return posted.select("token", "c", F.expr(u).alias("u"), "g0", "g1")


def _short(part: int, whole: int) -> str:
    """Whether a posting of the shorter of two sets, or of either of equal ones, can be the first that they share.

    They share part / (whole + part) of both sizes, so at least twice that of the shorter one, from this token on.
    """
    return f"{whole + part} * (shiftright(u, 1) & 2147483647) >= {2 * part} * shiftright(u, 32)"


def _near(part: int, whole: int, by_size: bool = False) -> Column:
    """Whether two postings a and b of one token are an unsettled class and an earlier one that may match.

    By size, b is the smaller one instead (of equal ones the earlier), and the later one of both is the unsettled one.
    The test that fails most comes first. None is of one side alone, as it would go below that side's exchange.
    """
    n, m, left = "shiftright(a.u, 32)", "shiftright(b.u, 32)", "(shiftright({}.u, 1) & 2147483647)"
    near = [f"{whole + part} * (bit_count(a.g0 ^ b.g0) + bit_count(a.g1 ^ b.g1)) <= {whole - part} * ({n} + {m})"]
    if by_size:
        near += [f"({n} > {m} OR {n} = {m} AND b.c < a.c)", "a.c <> b.c", "if(b.c < a.c, a.u, b.u) & 1 = 0"]
    else:
        near += ["b.c < a.c", "((a.u & 1) = 0 OR b.c < -1)"]
    near += [f"{whole} * least({n}, {m}) >= {part} * greatest({n}, {m})"]
    near += [f"{whole + part} * least({left.format('a')}, {left.format('b')}) >= {part} * ({n} + {m})"]
    return F.expr("a.token = b.token AND " + " AND ".join(near))


def _candidates(classes: DataFrame, part: int, whole: int, share: int = 0, shares: int = 1) -> DataFrame:
    """(c, c2): an unsettled class and an earlier one that may match, by the tokens of one of so many shares."""
    posted = _postings(classes).where(F.pmod("token", F.lit(shares)) == share)
    met = posted.alias("a").join(posted.where(_short(part, whole)).alias("b"), _near(part, whole, by_size=True))
    return met.select(F.greatest("a.c", "b.c").alias("c"), F.least("a.c", "b.c").alias("c2")).distinct()


def repeated_lines(docs: DataFrame, part: int = 75, whole: int = 100, short: int = 5) -> DataFrame:
    """(doc_id, th, removed): the numbers of the lines of a document that match an earlier line of the corpus.

    Lines are split at newlines and compared as sets of words (lower case, split at white space of ASCII); two match at
    a Jaccard similarity of part / whole or more. A line of fewer than `short` words has one token, the sequence of its
    words. Order is that of (doc_id, th, line number), null ids first; a line is removed if any earlier line matches it,
    whether that one stays or not. Lines without words always stay.

    Exact: tokens are ordered by rarity over the whole corpus (see rarity); lines of equal tokens are one class, and
    only classes are joined, on the prefix tokens that two matching sets must share one of, within the lengths,
    positions and parities that allow the similarity; each candidate is then verified on the words of both lines. Before
    the join, rounds of centres settle groups of near copies in a row or so for each member: each class meets one
    earlier class that holds one of its PIVOTS tokens, the earliest of those that earlier rounds have left. What they
    settle is no later side of the join, so that no group emits all its pairs.

    A null or empty text has no line to remove. Rows that repeat an id (null too) and a text are one document and are
    judged alike; th, a hash of the text, keeps different texts of one id apart. An empty table gives no rows; extra
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    place = ["doc_id", "th", "line_no"]
    hashed = scratch.write(tokens_of(docs, short))
    meta = written = scratch.write(signed_lines(hashed, part, whole))
    scratch.free(hashed)
    scratch.collect_garbage()
    grouped = meta.groupBy("s", "t").agg(F.min(F.struct(*place, "n", "g0", "g1", "prefix")).alias("f"), F.max(F.struct(*place)).alias("l"))
    grouped = grouped.select("s", "t", "f.*", (F.struct(*[f"f.{c}" for c in place]) != F.col("l")).alias("many"))
    ordered = grouped.repartitionByRange(*place, "s", "t").sortWithinPartitions(*place, "s", "t")
    sets = scratch.write(ordered.withColumn("c", F.monotonically_increasing_id()))
    places, classes = scratch.write(meta.select("s", "t", *place)), scratch.write(sets.select("c", "s", "t", *place, "many"))
    scratch.free(written)
    scratch.collect_garbage()

    def matching(pairs: DataFrame) -> DataFrame:
        """Of pairs (c, c2), those that match on the words of both."""
        ends = pairs.select("c").union(pairs.select("c2")).distinct().join(classes.select("c", *place, "s", "t"), "c")
        ends = scratch.write(ends)
        count = ends.count()
        wanted = _chosen(_lines(_chosen(_rows(docs), ends, count, place[:2])), ends, count, place)
        same = [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in place]
        wanted = wanted.join(ends.select("c", *[F.col(k).alias(f"e_{k}") for k in place]), same[0] & same[1] & same[2])
        wanted = wanted.groupBy("c").agg(F.first("line").alias("line")).select("c", _words("line").alias("words"))
        # one string for each line, as an array of words takes several times its room; no word holds a newline
        wanted = scratch.write(wanted.select("c", F.array_join(_tokens("words", short), "\n").alias("words")))
        other = wanted.select(F.col("c").alias("c2"), F.col("words").alias("words2"))
        both = pairs.join(wanted, "c").join(other, "c2")
        both = both.select("c", F.split("words", "\n").alias("words"), F.split("words2", "\n").alias("words2"))
        shared = F.size(F.array_intersect("words", "words2"))
        good = F.lit(whole + part) * shared >= F.lit(part) * (F.size("words") + F.size("words2"))
        out = scratch.write(both.where(good).select("c").distinct())
        scratch.free(ends, wanted)
        return out

    settled: list[DataFrame] = []
    left = sets.select("c", "n", "g0", "g1", "prefix")
    for _ in range(ROUNDS):
        few = left.select("c", "n", "g0", "g1", F.explode(F.slice(F.sort_array("prefix"), 1, PIVOTS)).alias("token"))
        # plain numbers, as a struct would be aggregated by sorting
        least = [F.min("c").alias("c2"), *[F.min_by(k, "c").alias(f"{k}2") for k in ("n", "g0", "g1")]]
        centre = few.groupBy("token").agg(*least, F.count("*").alias("k")).where("k > 1").drop("k")
        met = few.join(centre, "token").where((F.col("c2") < F.col("c")) & _may(part, whole))
        pairs = scratch.write(met.groupBy("c").agg(F.min("c2").alias("c2")))
        if pairs.count() <= FEW:
            break
        found = matching(pairs)
        settled.append(found)
        rest = scratch.write(pairs.select("c").join(found, "c", "left_anti"))
        left = _chosen(sets.select("c", "n", "g0", "g1", "prefix"), rest, rest.count(), ["c"])
        left = scratch.write(left.join(rest, "c", "left_semi"))
        scratch.collect_garbage()
        if not left.count():
            break
    gone = classes.select("c").where(F.lit(False))
    for found in settled:
        gone = gone.union(found)
    # what is settled has no earlier class to look for
    gone = scratch.write(gone.distinct().withColumn("done", F.lit(True)))
    open_ = _flagged(sets.select("c", "n", "g0", "g1", "prefix"), gone, ["c"], ["done"])
    open_ = scratch.write(open_.select("c", F.coalesce("done", F.lit(False)).alias("done"), "n", "g0", "g1", "prefix"))
    scratch.free(sets)
    scratch.collect_garbage()
    # postings are most of what is shuffled, so those of one share of the tokens go before the next ones come
    parts = []
    for k in range(SHARES):
        parts.append(scratch.write(_candidates(open_, part, whole, k, SHARES)))
        scratch.collect_garbage()
    scratch.free(open_)
    pairs = scratch.write(functools.reduce(DataFrame.union, parts).distinct())
    scratch.free(*parts)
    gone = gone.select("c").union(matching(pairs)).withColumn("none", F.lit(True))
    decided = classes.join(gone, "c", "left").withColumn("none", F.coalesce("none", F.lit(False))).where("none or many")
    decided = scratch.write(decided.select("s", "t", F.struct(*place).alias("first"), "none"))
    out = places.join(decided, ["s", "t"]).where(F.col("none") | (F.struct(*place) != F.col("first")))
    out = scratch.write(out.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("removed")))
    scratch.free(places, classes, decided)
    scratch.collect_garbage()
    return out


def _kept(removed: str, text: str) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda line, k: ~F.array_contains(removed, k))
    return F.when(F.col(removed).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))


def _with_removed(docs: DataFrame, **options) -> DataFrame:
    """(row, text, removed): each row of docs as it is, its text, and the numbers of the lines that go (null for none)."""
    found = repeated_lines(docs, **options)
    found = found.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "removed")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.text").cast("string").alias("text"), F.col("row.doc_id").alias("_id"))
    rows = rows.withColumn("_th", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    return _flagged(rows, found, ["_id", "_th"], ["removed"])


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with those lines taken out of text; other columns and the number of rows stay as they are."""
    joined = _with_removed(docs, **options)
    return joined.select(*[(_kept("removed", "text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of each document; a null text has no lines."""
    joined = _with_removed(docs, **options)
    ends = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    lines = F.coalesce(ends + 1, F.lit(0)).cast("long")
    kept = F.sha2(F.coalesce(_kept("removed", "text"), F.lit("")), 256)
    return joined.select(F.col("row.doc_id").alias("doc_id"), lines.alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_sha256"))
