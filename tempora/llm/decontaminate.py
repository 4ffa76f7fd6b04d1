"""Benchmark decontamination with built-in functions only.

The benchmark's windows of 8 words (a shorter item is one window) become a hash set that
goes to every task with the plan. Every window of every document is hashed and looked up;
a hit is verified by comparing the window's words, and then marks its words. Documents never
leave their rows for the scan: only the windows that were hit are joined back to their items.

The set's size is checked. Above MAX_WINDOWS the query and the pipeline number the rows, shuffle
(row, place, hash) of all their windows to the benchmark's and verify the words of what meets
with the row. Callers that don't ask for it get the set or an error: windows that occur nowhere
in the corpus are dropped by a shuffled semi-join, and if still too many are left it is raised.

Defined results: null texts have no words and no hits; items without words have no window;
items without an id count as one item of id null, which is left out of the list; repeated
rows and repeated items change nothing for other rows; without a benchmark nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import quoted, table, written

WINDOW, MAX_WINDOWS = 8, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All characters that are in no word, once A-Z are lower-cased; and those that are in one.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BETWEEN, -1), "")


def window_at(length: int) -> str:
    return f"slice(__words, i, {length})"


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id, length, window (its words, joined by blanks), hash: distinct rows."""
    w = items.select("item_id", words("text").alias("__words")).where(F.size("__words") > 0)
    w = w.withColumn("length", F.least(F.size("__words"), F.lit(WINDOW)))
    w = w.withColumn("__at", F.explode(F.expr("sequence(1, size(__words) - length + 1)")))
    w = w.select("item_id", "length", F.expr("slice(__words, __at, length)").alias("__words"))
    return w.select("item_id", "length", F.array_join("__words", " ").alias("window"), F.xxhash64("__words").alias("hash")).distinct()


def occurring(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """The windows that occur in some document, found by a shuffled semi-join on their hashes."""
    lengths = [r[0] for r in windows.select("length").distinct().orderBy("length").collect()]
    tokens = docs.select(words("text").alias("__words"))
    found = None
    for n in lengths:
        h = tokens.where(F.size("__words") >= n).select(F.explode(F.expr(f"array_distinct(transform(sequence(1, size(__words) - {n - 1}), i -> xxhash64({window_at(n)})))")).alias("hash")).distinct()
        part = windows.where(F.col("length") == n).join(h, "hash", "left_semi")
        found = part if found is None else found.unionByName(part)
    return windows if found is None else found


HITS = "array<struct<at: int, n: int>>"


def joined_positions(docs: DataFrame, sets: DataFrame, keep: list[str]) -> DataFrame:
    """hit_positions() for any number of windows: no task holds more than its share of them."""
    rows = docs.select(*keep, words("text").alias("__words")).withColumn("__at_row", F.monotonically_increasing_id())
    rows = written(docs.sparkSession, rows, "numbered")
    met = None
    for (n,) in sets.select("length").distinct().orderBy("length").collect():  # 1 to WINDOW
        hashes = F.posexplode(F.expr(f"transform(sequence(1, size(__words) - {n - 1}), i -> xxhash64({window_at(n)}))")).alias("__pos", "hash")
        at = rows.where(F.size("__words") >= n).select("__at_row", hashes)
        part = at.join(sets.where(F.col("length") == n).select("hash", "window"), "hash").select("__at_row", F.struct((F.col("__pos") + 1).alias("at"), F.lit(n).alias("n"), "window").alias("met"))
        met = part if met is None else met.unionByName(part)
    if met is None:
        return rows.drop("__at_row").withColumn("__hits", F.expr(f"cast(array() as {HITS})"))
    met = met.groupBy("__at_row").agg(F.collect_list("met").alias("__met"))
    hits = "transform(filter(__met, h -> array_join(slice(__words, h.at, h.n), ' ') = h.window), h -> struct(h.at as at, h.n as n))"
    hits = F.coalesce(F.expr(hits).cast(HITS), F.expr(f"cast(array() as {HITS})"))
    return rows.join(met, "__at_row", "left").withColumn("__hits", hits).drop("__at_row", "__met")


def hit_positions(docs: DataFrame, windows: DataFrame, keep: list[str], shuffled: bool = False) -> DataFrame:
    """keep, __words, and __hits: (first word, length) of every verified window of each row."""
    sets = windows.select("length", "hash", "window").distinct()
    if (many := sets.count() > MAX_WINDOWS) and shuffled:
        return joined_positions(docs, sets, keep)
    if many:
        sets = written(docs.sparkSession, occurring(sets, docs), "occurring")
        if (n := sets.count()) > MAX_WINDOWS:
            raise ValueError(f"{n} benchmark windows occur in the corpus; at most {MAX_WINDOWS} go to every task")
    by_length: dict[int, list[tuple[int, str]]] = {}
    for length, h, window in sets.select("length", "hash", "window").collect():  # at most MAX_WINDOWS rows
        by_length.setdefault(length, []).append((h, window))
    rows = docs.select(*keep, words("text").alias("__words"))
    parts = []
    for length, known in sorted(by_length.items()):
        hashes = ",".join(f"{h}L" if h != -(2**63) else "(-9223372036854775807L - 1L)" for h, _ in known)
        texts = ",".join(f"'{w}'" for _, w in known)
        at = window_at(length)
        parts.append(
            f"if(size(__words) >= {length}, transform(filter(sequence(1, size(__words) - {length - 1}), "
            f"i -> xxhash64({at}) in ({hashes}) and array_join({at}, ' ') in ({texts})), i -> struct(i as at, {length} as n)), array())"
        )
    none = f"cast(array() as {HITS})"
    return rows.withColumn("__hits", F.expr(f"concat({none}, {', '.join(parts)})" if parts else none))


#: Numbers of the words that are within a hit.
HIT_WORDS = "array_distinct(flatten(transform(__hits, h -> sequence(h.at, h.at + h.n - 1))))"


#: Columns that contamination() makes or works with.
MADE = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item", "window", "__words", "__hits", "__met", "__at_row", "__windows", "__items", "__row", "__clean", "__original", "__gaps"}


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), clean: bool = False, shuffled: bool = False) -> DataFrame:
    """keep, n_words, n_hit, n_items, items_sha256, contaminated; one row for each of docs.

    With `clean`, also __clean: the text without its hit words and what follows each of them,
    null where nothing was hit. With `shuffled`, more than MAX_WINDOWS windows are joined by a
    shuffle instead of an error. Items are joined to numbered rows that were written to the
    shared folder, so nothing is scanned twice and repeated rows stay apart. Names of what is
    returned can't be kept.
    """
    if clash := MADE & {c.lower() for c in keep}:
        raise ValueError(f"rename {sorted(clash)} first")
    windows = benchmark_windows(benchmark)
    columns = [*keep, "text"] if clean and "text" not in keep else [*keep]
    rows = hit_positions(docs, windows, columns, shuffled)
    hit = F.expr("size(__hits) > 0")
    out = [*keep, F.size("__words").cast("long").alias("n_words"), F.expr(f"cast(size({HIT_WORDS}) as bigint)").alias("n_hit")]
    out.append(F.expr("array_distinct(transform(__hits, h -> array_join(slice(__words, h.at, h.n), ' ')))").alias("__windows"))
    if clean:
        original = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
        gaps = F.split("text", WORD, -1)
        kept = f"array_except(sequence(1, size(__words)), {HIT_WORDS})"
        rows = rows.withColumn("__original", F.when(hit, original)).withColumn("__gaps", F.when(hit, gaps))
        out.append(F.when(hit, F.expr(f"concat(__gaps[0], array_join(transform({kept}, i -> concat(__original[i - 1], __gaps[i])), ''))")).alias("__clean"))
    scanned = written(spark, rows.select(*out).withColumn("__row", F.monotonically_increasing_id()), "scanned")
    by_window = windows.select("window", F.col("item_id").cast("string").alias("item"))
    by_window = F.broadcast(by_window) if windows.count() <= MAX_WINDOWS else by_window
    found = scanned.select("__row", F.explode("__windows").alias("window")).join(by_window, "window")
    items = found.groupBy("__row").agg(F.array_sort(F.collect_set("item")).alias("__items"))
    joined = scanned.join(items, "__row", "left").withColumn("__items", F.coalesce("__items", F.expr("cast(array() as array<string>)")))
    end = ["__clean"] if clean else []
    return joined.select(*keep, "n_words", "n_hit", F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.size("__items") >= 2).alias("contaminated"), *end)


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents; documents hit by one item alone lose the words that were hit."""
    names = docs.columns
    # columns of any names: only the text keeps its own
    own = {c: "text" if c == "text" else f"__kept{k}" for k, c in enumerate(names)}
    rows = docs.select(*[c.alias(n) for c, n in zip(quoted(names), own.values(), strict=True)])
    checked = contamination(spark, rows, benchmark, tuple(own.values()), clean=True, shuffled=True).where(~F.col("contaminated"))
    checked = checked.withColumn("text", F.coalesce("__clean", "text"))
    return checked.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(n).alias(c) for c, n in own.items()])


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shuffled=True)


#: A window's place in a document is found by its words between blanks.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 8) AS n, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT d.r, d.w, lens.n, unnest(range(1, len(d.w) - lens.n + 2)) AS i FROM d, lens WHERE len(d.w) >= lens.n)),
hits AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM hits GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(cover.n_hit, 0)::BIGINT AS n_hit, coalesce(items.n_items, 0)::BIGINT AS n_items, coalesce(items.s, sha256('')) AS items_sha256, coalesce(items.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cover ON d.r = cover.r LEFT JOIN items ON d.r = items.r
"""
