"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Tokens are numbers, letter runs and other numerals; what stands before a token doesn't matter for its
type.  A window of WIDTH tokens has these forms: the *number form* (numbers and units after numbers are
typed placeholders, other words are lowered), the *name form* (capitalised words are placeholders too)
and, where fewer than LEAST_WORDS words are left in the number form, the *literal form* in its place:
a list of numbers is only matched by the same numbers.  The name form needs as many words.
Windows of documents and benchmark items are joined by hash, form by form.  An item of SHORT to
WIDTH - 1 tokens is looked up by its first SHORT tokens and then compared literally as a whole, but for
case; an item of fewer tokens proves nothing and matches nothing.

Matches of a document and an item with one offset between them form an alignment.  Each slot of the
item votes for the value that it meets, and most votes decide what a value of the item becomes (two
values may become one); windows with another value are left out.  If there is no such majority the
value stays as it is, provided that nothing else has changed; otherwise the alignment shows nothing.
What is left shows the item itself or the item with other numbers and names (``reparameterised``).
A document is contaminated if alignments cover COVER of an item's windows or more.

The benchmark is the query set: its windows are broadcast only up to MOST_BROADCAST rows by count;
beyond, both sides are shuffled by hash.  A document is looked up in blocks of BLOCK tokens.

Null and empty texts have no window.  A document is a row's id with its text: rows that share an id
(a null id too) are judged apart, rows that repeat both are judged alike.  The same holds for items;
an empty benchmark matches nothing and an empty table stays empty.  Ties between items: the smallest id is named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, plain_id, solid_id, table, text_key

WIDTH, SHORT, LEAST_WORDS, COVER = 8, 4, 3, 0.5
MOST_BROADCAST = 2_000_000
#: Contaminated documents up to which their keys are broadcast.
MOST_KEYS = 100_000
BLOCK = 50_000
TOKEN = r"[0-9]+(?:[.,:/][0-9]+)*|\p{L}+|[^\P{N}0-9]+"
#: Units of measure that count as such after a number.
UNITS = (
    "km kg cm mm mg ml m g l h s min sec hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres "
    "mile miles feet foot inch inches pound pounds gram grams liter liters litre litres dollar dollars euro euros cent cents percent degree degrees"
).split()
#: Marks of a token that is a number, a unit after one, or may be a name; its value follows.
NUMBER, UNIT, NAME = "\u0001n", "\u0001u", "\u0001q"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def marked(text: Column) -> Column:
    """The text's tokens, lowered; numbers, units and capitalised words with their marks."""

    def mark(w: Column, low: Column, before: Column) -> Column:
        unit = low.isin(UNITS) & (before >= "0") & (before < ":")
        same = F.when((low >= "0") & (low < ":"), F.concat(F.lit(NUMBER), low)).when(F.coalesce(unit, F.lit(False)), F.concat(F.lit(UNIT), low)).otherwise(low)
        second = F.substring(w, 2, 1)
        name = (F.substring(w, 1, 1) != F.substring(low, 1, 1)) & (second != "") & (second == F.substring(low, 2, 1))
        return F.when(w == low, same).when(name, F.concat(F.lit(NAME), low)).otherwise(same)

    every = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    typed = lambda words: let(F.transform(words, F.lower), lambda low: F.transform(words, lambda w, i: mark(w, F.get(low, i), F.get(low, i - 1))))
    return let(every, typed)


def unpacked(*lists: str, kind: str) -> Column:
    """The structs of columns of lists as rows.

    The lists are made in a projection before: a generator that holds a lambda copies its row for each
    of its rows, and one over a mere column makes the optimizer put the column's expression into a filter.
    """
    fields = ", ".join(f"{name}:{type_}" for name, type_ in (f.split() for f in kind.split(", ")))
    return F.inline(F.concat(*lists, F.array().cast(f"array<struct<{fields}>>")))


def plain(word: Column) -> Column:
    return F.when(word.startswith("\u0001"), F.substring(word, 3, 1_000_000_000)).otherwise(word)


def number_form(words: Column) -> Column:
    """Hashes of the tokens, numbers and units by their mark alone."""
    return F.transform(words, lambda w: F.xxhash64(F.when(w.startswith(NAME), plain(w)).when(w.startswith("\u0001"), F.substring(w, 1, 2)).otherwise(w)))


def name_form(words: Column) -> Column:
    """Hashes of the tokens, whatever is marked by its mark alone."""
    return F.transform(words, lambda w: F.xxhash64(F.when(w.startswith("\u0001"), F.substring(w, 1, 2)).otherwise(w)))


def literal_form(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(plain(w)))


def hashed(tokens: Column, at: Column, form: int, width: int = WIDTH) -> Column:
    """The hash of the window at ``at`` (from 0), another one for each form."""
    return F.xxhash64(F.lit(form), F.slice(tokens, at + 1, width))


def starts(size: Column, width: int = WIDTH) -> Column:
    return F.when(size >= width, F.sequence(F.lit(0), size - width)).otherwise(F.array().cast("array<int>"))


def where(words: Column, *marks: str) -> Column:
    """Places of the tokens with one of the marks."""
    has = lambda w: w.startswith(marks[0]) if len(marks) == 1 else w.startswith(marks[0]) | w.startswith(marks[1])
    return F.filter(F.transform(words, lambda w, k: F.when(has(w), k)), lambda k: k.isNotNull())


def around(words: Column, width: int = WIDTH) -> Column:
    """Starts of the windows that hold a capitalised word."""
    last = F.size(words) - width
    spread = F.transform(where(words, NAME), lambda k: F.sequence(F.greatest(k - width + 1, F.lit(0)), F.least(k, last)))
    return F.when(last >= 0, F.array_distinct(F.flatten(spread))).otherwise(F.array().cast("array<int>"))


def numeric(words: Column, width: int = WIDTH, least: int = LEAST_WORDS) -> Column:
    """Starts of the windows with fewer than ``least`` tokens besides numbers and units."""
    need, last = width - least + 1, F.size(words) - width

    def spread(places: Column) -> Column:
        runs = F.transform(places, lambda k, j: F.struct(k.alias("a"), F.get(places, j + (need - 1)).alias("b")))
        near = F.filter(runs, lambda r: r["b"] - r["a"] < width)
        near = F.filter(near, lambda r: (F.greatest(r["b"] - width + 1, F.lit(0)) <= F.least(r["a"], last)))
        return F.array_distinct(F.flatten(F.transform(near, lambda r: F.sequence(F.greatest(r["b"] - width + 1, F.lit(0)), F.least(r["a"], last)))))

    return F.when(last >= 0, let(where(words, NUMBER, UNIT), spread)).otherwise(F.array().cast("array<int>"))


def slots(words: Column, at: Column, form: Column, width: int = WIDTH) -> Column:
    """The slots (place in the text, value) of the window that begins at ``at``, as the form has them."""
    placed = F.transform(F.slice(words, at + 1, width), lambda w, k: F.struct((at + k).alias("place"), w.alias("value")))
    return F.filter(placed, lambda s: s["value"].startswith("\u0001") & ((form == 1) | (form == 0) & ~s["value"].startswith(NAME)))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_key, i_windows, i_at, h, form, i_slots, whole) of the windows of each item.

    Forms: 0 numbers, 1 names, 2 literal, 3 the first tokens of a short item, of which ``whole`` has all.
    """
    items = benchmark.select("item_id", text_key().alias("item_key"), marked(F.col("text")).alias("words")).filter(F.size("words") >= SHORT).distinct()
    size = F.size("words")
    items = items.withColumns({"t0": number_form(F.col("words")), "t1": name_form(F.col("words")), "t2": literal_form(F.col("words")), "size": size})
    left = lambda at, mark: F.size(F.filter(F.slice("words", at + 1, WIDTH), mark))

    def forms(at: Column) -> Column:
        words = left(at, lambda w: ~w.startswith("\u0001") | w.startswith(NAME))
        bare = left(at, lambda w: ~w.startswith("\u0001"))
        one = lambda form, tokens: F.struct(at.alias("i_at"), F.lit(form).alias("form"), hashed(tokens, at, form).alias("h"))
        first = F.when(words >= LEAST_WORDS, one(0, F.col("t0"))).otherwise(one(2, F.col("t2")))
        return F.when((bare >= LEAST_WORDS) & (words > bare), F.array(first, one(1, F.col("t1")))).otherwise(F.array(first))

    long_ = F.flatten(F.transform(starts(F.col("size")), forms))
    short = F.array(F.struct(F.lit(0).alias("i_at"), F.lit(3).alias("form"), hashed(F.col("t0"), F.lit(0), 3, SHORT).alias("h")))
    rows = items.select("item_id", "item_key", "words", F.greatest(F.col("size") - WIDTH + 1, F.lit(1)).alias("i_windows"), F.inline(F.when(F.col("size") < WIDTH, short).otherwise(long_)))
    whole = F.when(F.col("form") == 3, F.transform("words", plain))
    return rows.select("item_id", "item_key", "i_windows", "i_at", "h", "form", slots(F.col("words"), F.col("i_at"), F.col("form")).alias("i_slots"), whole.alias("whole"))


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(id, text_key, begin, words): documents in blocks of ``size`` tokens, each with the first tokens of the next."""
    base = docs.select(solid_id().alias("id"), text_key().alias("text_key"), marked(F.col("text")).alias("every"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("every") - 1, F.lit(0)), F.lit(size)), lambda k: F.struct(k.alias("begin"), F.slice("every", k + 1, size + WIDTH - 1).alias("words")))
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("every").alias("words")))
    return base.select("id", "text_key", F.when(F.size("every") <= size + WIDTH - 1, whole).otherwise(cut).alias("cut")).select("id", "text_key", unpacked("cut", kind="begin int, words array<string>"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Matching windows: id, text_key, at, item_id, item_key, i_at, i_windows and the slots of both sides; ``same`` isn't true if a short item as a whole differs."""
    facts = items.agg(F.count("*").alias("n"), F.collect_set("form").alias("forms")).first()
    base = blocks(docs).withColumn("t0", number_form(F.col("words")))
    found = lambda at, tokens, form, width=WIDTH: F.transform(at, lambda i: F.struct(i.alias("at"), hashed(tokens, i, form, width).alias("h")))
    every = [found(starts(F.size("t0")), F.col("t0"), 0)]
    if 1 in facts["forms"]:
        base = base.withColumn("t1", name_form(F.col("words")))
        every.append(F.when(F.size("t1") >= 0, found(around(F.col("words")), F.col("t1"), 1)))
    if 2 in facts["forms"]:
        base = base.withColumn("t2", literal_form(F.col("words")))
        every.append(F.when(F.size("t2") >= 0, found(numeric(F.col("words")), F.col("t2"), 2)))
    if 3 in facts["forms"]:
        every.append(found(starts(F.size("t0"), SHORT), F.col("t0"), 3, SHORT))
    rows = base.select("id", "text_key", "begin", "words", *(e.alias(f"e{k}") for k, e in enumerate(every))).select("id", "text_key", "begin", "words", unpacked(*(f"e{k}" for k in range(len(every))), kind="at int, h bigint"))
    value = F.transform(slots(F.col("words"), F.col("at"), F.col("form")), lambda s: s["value"]).alias("d_slots")
    # a filter on this would become a condition of the join, which then copies the words for every window
    # and null is for an item that goes beyond the block, which the next block has whole
    own = F.slice("words", F.col("at") + 1, F.greatest(F.size("whole"), F.lit(0)))
    same = F.when(F.col("whole").isNull(), True).when(F.size(own) == F.size("whole"), F.transform(own, plain) == F.col("whole"))
    kept = ["id", "text_key", (F.col("begin") + F.col("at")).alias("at"), "item_id", "item_key", "i_at", "i_windows", "i_slots", value, same.alias("same")]
    if facts["n"] <= MOST_BROADCAST:
        # the words stay in the row that is being looked up; slots are cut out of matches alone
        return rows.join(F.broadcast(items), "h").select(*kept)
    cut = F.slice("words", F.col("at") + 1, WIDTH).alias("words")
    return rows.select("id", "text_key", (F.col("begin") + F.col("at")).alias("begin"), F.lit(0).alias("at"), "h", cut).join(items, "h").select(*kept)


def consistent(lined: DataFrame) -> DataFrame:
    """Alignments with those of their ``windows`` (i_at, pairs (place, i, d)) that keep to one value for each value of the item."""
    voted = lined.withColumn("votes", F.array_distinct(F.flatten(F.transform("windows", lambda w: w["pairs"]))))
    alike = lambda p: F.filter("votes", lambda q: q["i"] == p["i"])
    same = lambda p: F.filter("votes", lambda q: (q["i"] == p["i"]) & (q["d"] == p["d"]))
    rated = voted.withColumn("rated", F.transform("votes", lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"), (2 * F.size(same(p)) > F.size(alike(p))).alias("most"), (F.size(same(p)) == F.size(alike(p))).alias("alone"))))
    rated = rated.withColumn("verbatim", F.forall("rated", lambda r: (r["i"] == r["d"]) | ~r["alone"]))
    settled = lambda r: F.exists("rated", lambda q: (q["i"] == r["i"]) & q["most"])
    chosen = rated.withColumn("chosen", F.filter("rated", lambda r: r["most"] | (F.col("verbatim") & (r["i"] == r["d"]) & ~settled(r))))
    sound = chosen.filter(F.forall("votes", lambda p: F.exists("chosen", lambda c: c["i"] == p["i"])))
    holds = lambda p: F.exists("chosen", lambda c: (c["i"] == p["i"]) & (c["d"] == p["d"]))
    return sound.withColumn("windows", F.filter("windows", lambda w: F.forall(w["pairs"], holds)))


def verdicts(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """One row for each contaminated document and item: id, text_key, item_id, coverage, reparameterised."""
    hit = matches(docs, item_windows(benchmark))
    pairs = F.zip_with("i_slots", "d_slots", lambda i, d: F.struct(i["place"].alias("place"), i["value"].alias("i"), d.alias("d")))
    grouped = hit.withColumn("offset", F.col("at") - F.col("i_at")).groupBy("id", "text_key", "item_id", "item_key", "offset")
    lined = grouped.agg(F.bool_and("same").alias("same"), F.max("i_windows").alias("i_windows"), F.collect_set(F.struct("i_at", pairs.alias("pairs"))).alias("windows")).filter("same")
    kept = consistent(lined).withColumn("covered", F.transform("windows", lambda w: w["i_at"]))
    changed = F.exists("windows", lambda w: F.exists(w["pairs"], lambda p: p["i"] != p["d"]))
    one = kept.groupBy("id", "text_key", "item_id", "item_key")
    found = one.agg((F.size(F.array_distinct(F.flatten(F.collect_list("covered")))) / F.max("i_windows")).alias("coverage"), F.max(changed).alias("reparameterised"))
    return found.filter(F.col("coverage") >= cover).drop("item_key")


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (smallest), coverage (largest) and reparameterised of every row."""
    by_doc = verdicts(docs, benchmark).groupBy("id", "text_key").agg(F.count("*").alias("n_items"), F.min("item_id").alias("item_id"), F.max("coverage").alias("coverage"), F.max("reparameterised").alias("reparameterised"))
    every = docs.select(solid_id().alias("id"), text_key().alias("text_key")).join(few(by_doc, MOST_KEYS), ["id", "text_key"], "left")
    return every.select(plain_id("id").alias("doc_id"), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "item_id", F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that aren't contaminated, with all their columns; a row goes for its own text alone."""
    bad = verdicts(docs, benchmark).select(F.col("id").alias("contaminated_id"), F.col("text_key").alias("contaminated_key")).distinct()
    bad = few(bad, MOST_KEYS)
    return docs.join(bad, (solid_id(docs["doc_id"]) == bad["contaminated_id"]) & (text_key(docs["text"]) == bad["contaminated_key"]), "left_anti")


#: The verdicts of :func:`judge` over ``documents`` and ``benchmark``, by rows of tokens; a text of words joined by spaces stands for a window's hash.
SQL = rf"""WITH doc AS (SELECT row_number() OVER () AS n, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)),
 item AS (SELECT row_number() OVER () AS n, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
 list_ AS (SELECT 'd' AS side, n, regexp_extract_all(text, '{TOKEN}') AS ws FROM doc UNION ALL SELECT 'i', n, regexp_extract_all(text, '{TOKEN}') FROM item),
 word AS (SELECT side, n, unnest(range(len(ws))) AS p, unnest(ws) AS w, len(ws) AS size FROM list_),
 low AS (SELECT *, lower(w) AS l, lag(lower(w)) OVER (PARTITION BY side, n ORDER BY p) AS before FROM word),
 token AS (SELECT side, n, p, size, l, CASE WHEN substr(w, 1, 1) <> substr(l, 1, 1) AND substr(w, 2, 1) <> '' AND substr(w, 2, 1) = substr(l, 2, 1) THEN '#q' WHEN l >= '0' AND l < ':' THEN '#n'
  WHEN l IN ({", ".join(f"'{u}'" for u in UNITS)}) AND before >= '0' AND before < ':' THEN '#u' ELSE '' END AS mark FROM low),
 view_ AS (SELECT side, n, p, size, string_agg(CASE WHEN mark IN ('#n', '#u') THEN mark ELSE l END, ' ') OVER w8 AS g0, string_agg(CASE WHEN mark <> '' THEN mark ELSE l END, ' ') OVER w8 AS g1, string_agg(l, ' ') OVER w8 AS g2,
  string_agg(CASE WHEN mark IN ('#n', '#u') THEN mark ELSE l END, ' ') OVER w4 AS s4, count(*) FILTER (mark NOT IN ('#n', '#u')) OVER w8 AS words, count(*) FILTER (mark = '') OVER w8 AS bare
  FROM token WINDOW w8 AS (PARTITION BY side, n ORDER BY p ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING), w4 AS (PARTITION BY side, n ORDER BY p ROWS BETWEEN CURRENT ROW AND {SHORT - 1} FOLLOWING)),
 full_ AS (SELECT * FROM view_ WHERE p + {WIDTH} <= size),
 asked AS (SELECT n AS m, p AS i_at, size, CASE WHEN words >= {LEAST_WORDS} THEN 0 ELSE 2 END AS form, CASE WHEN words >= {LEAST_WORDS} THEN g0 ELSE g2 END AS g FROM full_ WHERE side = 'i'
  UNION ALL SELECT n, p, size, 1, g1 FROM full_ WHERE side = 'i' AND bare >= {LEAST_WORDS} AND words > bare UNION ALL SELECT n, p, size, 3, s4 FROM view_ WHERE side = 'i' AND p = 0 AND size BETWEEN {SHORT} AND {WIDTH - 1}),
 given AS (SELECT n AS d, p, 0 AS form, g0 AS g FROM full_ WHERE side = 'd' UNION ALL SELECT n, p, 1, g1 FROM full_ WHERE side = 'd' AND words > bare UNION ALL SELECT n, p, 2, g2 FROM full_ WHERE side = 'd' AND words < {LEAST_WORDS}
  UNION ALL SELECT n, p, 3, s4 FROM view_ WHERE side = 'd' AND p + {SHORT} <= size),
 met AS (SELECT d, m, p - i_at AS off, i_at, form, size FROM given JOIN asked USING (form, g)),
 whole AS (SELECT d, m, off FROM met JOIN token i ON i.side = 'i' AND i.n = m JOIN token t ON t.side = 'd' AND t.n = d AND t.p = off + i.p AND t.l = i.l WHERE form = 3 GROUP BY d, m, off, met.size HAVING count(*) = met.size),
 hit AS (SELECT * FROM met WHERE form <> 3 UNION ALL SELECT met.* FROM met JOIN whole USING (d, m, off) WHERE form = 3),
 pair AS (SELECT d, m, off, i_at, form, i.p AS place, i.mark || i.l AS iv, t.mark || t.l AS dv FROM hit JOIN token i ON i.side = 'i' AND i.n = m AND i.p BETWEEN i_at AND i_at + {WIDTH - 1}
  JOIN token t ON t.side = 'd' AND t.n = d AND t.p = off + i.p WHERE (form = 0 AND i.mark IN ('#n', '#u')) OR (form = 1 AND i.mark <> '')),
 vote AS (SELECT *, count(*) OVER (PARTITION BY d, m, off, iv) AS alike, count(*) OVER (PARTITION BY d, m, off, iv, dv) AS same FROM (SELECT DISTINCT d, m, off, place, iv, dv FROM pair)),
 rated AS (SELECT *, 2 * same > alike AS most, bool_and(iv = dv OR same <> alike) OVER (PARTITION BY d, m, off) AS verbatim, bool_or(2 * same > alike) OVER (PARTITION BY d, m, off, iv) AS settled FROM vote),
 chosen AS (SELECT DISTINCT d, m, off, iv, dv, most OR (verbatim AND iv = dv AND NOT settled) AS chosen FROM rated),
 unsound AS (SELECT DISTINCT d, m, off FROM chosen GROUP BY d, m, off, iv HAVING NOT bool_or(chosen)),
 kept AS (SELECT d, m, off, i_at, form, bool_or(iv <> dv) AS changed FROM pair JOIN chosen USING (d, m, off, iv, dv) GROUP BY d, m, off, i_at, form HAVING bool_and(chosen)
  UNION ALL SELECT d, m, off, i_at, form, FALSE FROM hit WHERE NOT EXISTS (SELECT 1 FROM pair WHERE pair.d = hit.d AND pair.m = hit.m AND pair.off = hit.off AND pair.i_at = hit.i_at AND pair.form = hit.form)),
 sound AS (SELECT * FROM kept ANTI JOIN unsound USING (d, m, off)),
 found AS (SELECT d, m, count(DISTINCT i_at)::DOUBLE / max(greatest(s.size - {WIDTH - 1}, 1)) AS coverage, bool_or(changed) AS changed FROM sound JOIN (SELECT DISTINCT m, size FROM asked) s USING (m) GROUP BY d, m),
 judged AS (SELECT d, count(*) AS n_items, min(item_id) AS item_id, max(coverage) AS coverage, bool_or(changed) AS changed FROM found JOIN item ON m = item.n WHERE coverage >= {COVER} GROUP BY d)
 SELECT a.doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, j.item_id, round(coalesce(coverage, 0), 6) AS coverage, coalesce(changed, FALSE) AS reparameterised
 FROM documents a JOIN doc ON doc.doc_id IS NOT DISTINCT FROM a.doc_id AND doc.text IS NOT DISTINCT FROM a.text LEFT JOIN judged j ON doc.n = j.d"""


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
