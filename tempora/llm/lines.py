"""Line dedup: a segment-partition edit-distance join, with built-in functions only.

Equal lines are copies, whatever their length; empty lines take no part. Two lines are near
copies if so many insertions, deletions and substitutions turn one into the other as a TENTH
of the shorter one's code points, EDITS at most. For each bound a line is split into one
segment more than there are edits, of which a near copy must hold one unchanged: every line
files its segments in an index, keyed by length, segment number and content, and probes it,
for each length from its own less the edits up to its own, with the substrings that can be
that segment (only at the offsets that the edits left and right of it allow). Keys that
one line has alone are counted out first. The lines under the others are compared by sketches
of their letters and words, inside the join, and the pairs left are verified by a banded bit-parallel edit distance: an automaton with one word of bits for
each number of edits, a bit for each diagonal, that takes a character in a few operations.
The first line of each component (by doc_id, then place) stays and the others go.

Distinct lines are one node, known by a 64-bit hash. A key that very many lines share is an
equi-join key of two plain exchanges, whose large partitions the planner splits.

Defined results: null texts have no lines and stay null; empty lines always stay; rows with
equal doc_id are one document, whose lines at the same place with the same content are one
line; rows without a doc_id are one document that comes last; an empty table gives no row;
other columns are carried along, under any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import discard, fresh, quoted, table, written
from tempora.llm.components import components

EDITS, TENTH = 2, 10
#: Hashes that may go to every task; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
LETTERS = "etanioruhsdlcgmp"


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def split_lines(text: str = "text") -> Column:
    return F.split(text, "\n", -1)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, place (from 0) and line: every line that isn't empty."""
    return docs.select("doc_id", F.posexplode(split_lines()).alias("place", "line")).where("line <> ''")


def letter_counts(line: Column) -> Column:
    """Counts of sixteen letters, modulo 16, four bits each: an edit changes two of them by one at most."""
    out = F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(15)).cast("long"), 4 * k))
    return out


def counts_apart(a: Column, b: Column) -> Column:
    """The least sum of differences that counts with these remainders can have."""
    out = F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        # cut to four bits before they are subtracted: whole numbers could overflow
        x, y = (F.shiftrightunsigned(n, 4 * k).bitwiseAND(F.lit(15)) for n in (a, b))
        apart = F.abs(x - y)
        out = out + F.least(apart, 16 - apart)
    return out


def word_parities(line: str) -> Column:
    """64 bits; each word between blanks turns one over. An edit changes, parts or joins words: three bits at most."""
    return F.expr(f"aggregate(split({line}, ' ', -1), 0L, (held, w) -> held ^ shiftleft(1L, cast(xxhash64(w) & 63L as int)))")


def segment_keys(edits: int) -> list[tuple[int, int, int, bool]]:
    """(length less the line's own, segment number, offset, filed in the index too) of all keys of a line."""
    out = []
    for less in range(edits + 1):
        for i in range(1, edits + 2):
            low, high = max(1 - i, less - (edits + 1 - i)), min(i - 1, less + (edits + 1 - i))
            out += [(less, i, o, less == 0 and o == 0) for o in range(low, high + 1)]
    return out


def filed(rows: DataFrame, most: int = EDITS) -> DataFrame:
    """key, id, role (1: index, 2: probe, 3: both) for rows (line); copies of a line give equal rows.

    The bound on the edits is that of the length that a key is for, which is the shorter line's.
    """
    each = [f"named_struct('edits', {e}, 'less', {less}, 'i', {i}, 'offset', {o}, 'role', {3 if both else 2})" for e in range(1, most + 1) for less, i, o, both in segment_keys(e)]
    keys = F.explode(F.expr(f"array({', '.join(each)})")).alias("k")
    rows = rows.select("line", F.length("line").alias("n"), line_hash(F.col("line")).alias("id")).where(F.col("n") >= TENTH).select("line", "n", "id", keys)
    size, parts = F.col("n") - F.col("k.less"), F.col("k.edits") + 1
    base, ahead = F.floor(size / parts).cast("int"), F.col("k.i") - 1
    short = parts - size % parts  # so many segments have the base length, the rest one more
    at = ahead * base + F.greatest(F.lit(0), ahead - short) + 1 + F.col("k.offset")
    length = base + (ahead >= short).cast("int")
    bound = F.least(F.lit(most), F.floor(size / TENTH)) == F.col("k.edits")
    key = F.xxhash64(size, "k.i", F.substring("line", at, length)).alias("key")
    return rows.where(bound & (at >= 1) & (at + length - 1 <= F.col("n"))).select(key, "id", "k.role")


def met(keys: DataFrame) -> DataFrame:
    """The rows of the few keys that an indexed line shares with another; each once.

    Most keys are one line's alone. They are counted out by an aggregate with partial sums,
    so that copies of a line, and nothing but numbers, are all that it moves.
    """
    spark = keys.sparkSession
    ids = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max("role").alias("role"))
    shared = written(spark, ids.where("least <> most and role = 3").select("key"), "shared")
    rows = written(spark, keys.join(small(shared), "key", "left_semi").distinct(), "met")
    discard(shared)
    return rows


def small(rows: DataFrame) -> DataFrame:
    """rows, sent to every task if they are few; otherwise the planner chooses."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def candidates(keys: DataFrame, sketches: DataFrame, most: int = EDITS) -> DataFrame:
    """Pairs (a, b), a < b, of lines that share a key and aren't told apart by their sketches (id, letters, words)."""
    keys = keys.join(sketches, "id")
    index = keys.where("role = 3").select("key", F.col("id").alias("a"), F.col("letters").alias("la"), F.col("words").alias("wa"))
    probe = keys.select("key", F.col("id").alias("b"), F.col("letters").alias("lb"), F.col("words").alias("wb"))
    by_words = F.bit_count(F.col("wa").bitwiseXOR(F.col("wb"))) <= 3 * most
    by_letters = counts_apart(F.col("la"), F.col("lb")) <= 2 * most
    pairs = index.join(probe.hint("merge"), (index["key"] == probe["key"]) & (F.col("a") != F.col("b")) & by_words & by_letters)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def within(a: str, b: str, most: int = EDITS) -> Column:
    """The edit distance of two columns, null above `most`; their lengths must not be further apart.

    r0, r1, ... are the cells of a column of the table that are reached with 0, 1, ... edits,
    as bits: bit t is for the first t + j - most characters of a, after j characters of b.
    """
    band, full = 2 * most + 1, (1 << (2 * most + 1)) - 1
    # which of the band's characters of a are the j-th of b, counted from 0
    same = " | ".join(f"if(get(s.a, j + {t - most}) <=> c, {1 << t}, 0)" for t in range(band))
    step = ["r.r0 & m"]
    for d in range(1, most + 1):
        step.append(f"((r.r{d} & m) | r.r{d - 1} | shiftrightunsigned(r.r{d - 1}, 1) | shiftleft({step[-1]}, 1)) & {full}")
    start = ", ".join(f"'r{d}', {sum(1 << (most + i) for i in range(d + 1))}" for d in range(most + 1))
    then = ", ".join(f"'r{d}', {s}" for d, s in enumerate(step))
    end = " ".join(f"when (shiftright(r.r{d}, size(s.a) - size(s.b) + {most}) & 1) = 1 then {d}" for d in range(most + 1))
    walk = f"aggregate(transform(s.b, (c, j) -> {same}), named_struct({start}), (r, m) -> named_struct({then}), r -> case {end} end)"
    # bound once: a column would be split again wherever it is named
    return F.expr(f"transform(array(named_struct('a', split({a}, ''), 'b', split({b}, ''))), s -> {walk})[0]")


def near_lines(spark: SparkSession, docs: DataFrame, most: int = EDITS) -> DataFrame:
    """Links (a, b) between the hashes of near copies."""
    found = lines(docs).select("line")
    keys = met(filed(found, most))
    texts = found.withColumn("id", line_hash(F.col("line"))).join(small(keys.select("id").distinct()), "id", "left_semi").distinct()
    texts = written(spark, texts.withColumns({"letters": letter_counts(F.col("line")), "words": word_parities("line")}), "texts")
    pairs = candidates(keys, texts.select("id", "letters", "words"), most)
    a, b = texts.select(F.col("id").alias("a"), F.col("line").alias("la")), texts.select(F.col("id").alias("b"), F.col("line").alias("lb"))
    allowed = F.least(F.lit(most), F.floor(F.least(F.length("la"), F.length("lb")) / TENTH))
    links = written(spark, pairs.join(a, "a").join(b, "b").where(within("la", "lb", most) <= allowed).select("a", "b"), "links")
    discard(keys)
    discard(texts)
    return links


def removed(spark: SparkSession, docs: DataFrame, most: int = EDITS) -> DataFrame:
    """doc_id and `gone`: (place, id) of its lines that go."""
    nodes = components(spark, near_lines(spark, docs, most))
    held = lines(docs).select("doc_id", "place", line_hash(F.col("line")).alias("id"))
    counted = held.groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    classed = counted.join(nodes, "id", "left").select("id", F.coalesce("component", "id").alias("class"), "first", "n")
    whole = classed.groupBy("class").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    repeated = classed.select("id", "class").join(whole.select("class", "first"), "class")
    mine = written(spark, held.join(repeated, "id").select("doc_id", "place", "id", "class", F.col("doc_id").eqNullSafe(F.col("first")).alias("own")), "repeated")
    # of a class's places in its first document the first stays; all other documents' go
    own = mine.where("own")
    stays = own.groupBy(F.col("class").alias("c")).agg(F.min("place").alias("stays"))
    again = own.join(stays, F.col("class") == F.col("c")).where("place <> stays").select("doc_id", "place", "id")
    gone = mine.where("not own").select("doc_id", "place", "id").unionByName(again)
    return gone.groupBy("doc_id").agg(F.collect_set(F.struct("place", "id")).alias("gone"))


def marked(spark: SparkSession, docs: DataFrame, columns: list[str], into: str = "places", most: int = EDITS) -> DataFrame:
    """The columns of docs and, under the name `into`, the places (from 0) of each row's lines that go, in order."""
    own, found, hashes = (fresh([*docs.columns, into], n) for n in ("own", "gone", "hashes"))
    gone = removed(spark, docs, most).toDF(own, found)
    rows = docs.withColumn(hashes, F.transform(split_lines(), line_hash)).join(gone, F.col("doc_id").eqNullSafe(F.col(own)), "left")
    # rows with equal doc_id share the list: only lines of that content go
    places = f"array_sort(transform(filter({found}, g -> get({hashes}, g.place) <=> g.id), g -> g.place))"
    return rows.select(*quoted(columns), F.coalesce(F.expr(places), F.expr("cast(array() as array<int>)")).alias(into))


def without_repeats(spark: SparkSession, docs: DataFrame, most: int = EDITS) -> DataFrame:
    """docs without the lines that go; all columns stay, n_chars (if there) follows the text."""
    into = fresh(docs.columns, "places")
    rows = marked(spark, docs, docs.columns, into, most)
    kept = F.expr(f"transform(array(split(text, '\\n', -1)), lines -> array_join(transform(array_except(sequence(0, size(lines) - 1), {into}), p -> lines[p]), '\\n'))[0]")
    rows = rows.withColumn("text", F.when(F.size(into) > 0, kept).otherwise(F.col("text")))
    return rows.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else q for c, q in zip(docs.columns, quoted(docs.columns), strict=True)])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return marked(spark, docs, docs.columns).select(
        "doc_id",
        F.coalesce(F.size(split_lines()), F.lit(0)).cast("long").alias("n_lines"),
        F.size("places").cast("long").alias("n_removed"),
        F.array_join(F.col("places").cast("array<string>"), ",").alias("removed_lines"),
    )


OP10_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, i, lines[i + 1] AS line FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
u AS (SELECT DISTINCT line, length(line) AS n FROM l WHERE length(line) >= {TENTH}),
links AS (SELECT a.line AS a, b.line AS b FROM u a JOIN u b ON b.n BETWEEN a.n - {EDITS} AND a.n + {EDITS} WHERE a.line <> b.line AND levenshtein(a.line, b.line) <= least({EDITS}, least(a.n, b.n) // {TENTH})),
reach AS (SELECT a AS x, a AS y FROM links UNION SELECT reach.x, links.b FROM reach JOIN links ON reach.y = links.a),
class AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY coalesce(c, line) ORDER BY doc_id, i) > 1 AS gone FROM l LEFT JOIN class ON line = x WHERE line <> ''),
g AS (SELECT doc_id, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS s FROM placed WHERE gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.s, '') AS removed_lines
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
