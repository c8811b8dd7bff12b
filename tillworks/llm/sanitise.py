"""Personal data, and the words that give it away.

Base spans (e-mail, IP, card and phone numbers) come from patterns.  Then the corpus is asked how strongly words near a
protected value reveal it: with n(t, e) documents that show word t within ``WINDOW`` characters of value e, n(t) and n(e)
documents with either and N in all, the word discloses

    log2( n(t,e) N / (n(t) n(e)) )  /  log2( N / n(e) )

of the information in e: 1 when the word occurs with e only, 0 when it tells nothing.  Words that disclose ``REMOVE`` or more
are removed, those from ``GENERALISE`` on are generalised, wherever they stand near the value.  A pair counts when it was seen
in ``SUPPORT`` different contexts, so copies of one document are no evidence.

Everything is DataFrame expressions.  Only words near protected values are counted over the corpus: a bit filter of fixed
size drops all others in the scan, so neither texts nor the words of the corpus are shuffled.

Cases: NULL texts count as empty and have no spans; rows that repeat an id are judged one by one and counted as documents of
their own; a value that every document holds reveals nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import bit_filter, in_filter, staged

#: The patterns find what the plain ones do (given beside each), in linear time: runs are taken whole, and a run that has
#: been tried from its first character is not tried from the next one.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 13 digits or more: shorter runs cannot be cards
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "generalised", "removed"]
WORD_PATTERN = r"\p{L}{3,}"
WINDOW = 64
SUPPORT = 2
GENERALISE = 0.6
REMOVE = 0.9
TERM_BITS = 22
CHUNK = 64
#: So many spans on either side are looked at to tell whether a word is part of one.
NEIGHBOURS = 2 * WINDOW
SPAN = "struct<kind:int,start:int,end:int,value:string>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, kind: int, offset: Column | int = 0) -> Column:
    """Leftmost matches that do not overlap, as an array of (kind, start, end, value), in code points, end exclusive.
    The places follow from the lengths of the matches and of the pieces between them, summed in chunks: growing one array
    over all matches of a long text would take time with the square of their number."""
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(
        g.alias("gap"), m.alias("value")))
    steps = F.filter(steps, lambda s: s["value"].isNotNull())

    def cut(all_steps: Column) -> Column:
        last = F.floor((F.size(all_steps) - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(all_steps, c * CHUNK + 1, CHUNK))

    def begins(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + s["gap"] + F.length(s["value"])))
        zero = F.struct((F.lit(0) + offset).cast("int").alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(sizes, zero, lambda a, n: F.struct(
            (a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def place(chunk: Column, first: Column) -> Column:
        def step(acc: Column, item: Column) -> Column:
            begin = acc["at"] + item["gap"]
            end = begin + F.length(item["value"])
            span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), item["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(chunk, F.struct(first.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    found = _let(_let(steps, cut), lambda chunks: _let(begins(chunks), lambda first: F.flatten(F.transform(
        chunks, lambda c, i: place(c, first[i])))))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, 9 taken off above 9; the sum ends in 0."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str):
    def part_fits(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+(?=.)", "")
        return (F.length(short) <= 3) & (F.substring(short, 1, 4).cast("int") <= 255)

    checks = {
        "ip": lambda s: F.forall(F.split(s["value"], r"\."), part_fits),
        "card": lambda s: F.length(_digits(s["value"])).between(13, 19) & _luhn(_digits(s["value"])),
        "phone": lambda s: F.length(_digits(s["value"])).between(9, 15),
    }
    return checks.get(kind, lambda s: F.lit(True))


def base_spans(text: Column) -> Column:
    """Valid base spans of a text, by kind, then start."""
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    found = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = matches(text, pattern, number)
        spans = F.when(needs[kind], spans).otherwise(empty) if kind in needs else spans
        found.append(F.filter(spans, _valid(kind)))
    return F.concat(*found)


def _near(text: Column, span: Column, spans: Column) -> Column:
    """Whole words within the window around a span that touch no base span, as (kind, value, context, term, start, end)."""
    left_cut, size = span["start"] > WINDOW, F.length(text)
    # a blank stands for the border of the text, so that a word at the border counts as whole
    left = F.when(left_cut, F.substring(text, span["start"] - WINDOW + 1, F.lit(WINDOW))).otherwise(
        F.concat(F.lit(" "), F.substring(text, F.lit(1), span["start"])))
    right = F.concat(F.substring(text, span["end"] + 1, F.lit(WINDOW)),
                     F.when(size - span["end"] > WINDOW, "").otherwise(" "))
    before = matches(left, r"(?<=\P{L})" + WORD_PATTERN, 0, F.when(left_cut, span["start"] - WINDOW).otherwise(-1))
    after = matches(right, r"(?<!\p{L})" + WORD_PATTERN + r"(?=\P{L})", 0, span["end"])
    context = F.xxhash64(left, right)
    free = F.filter(F.concat(before, after), lambda w: ~F.exists(
        spans, lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"])))
    return F.transform(free, lambda w: F.struct(
        span["kind"].alias("kind"), span["value"].alias("value"), context.alias("context"),
        F.lower(w["value"]).alias("term"), w["start"].alias("start"), w["end"].alias("end")))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``, without the text: row_no, key, spans (base), near (words around them)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("spans", base_spans(F.col("text")))
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] == b["start"], a["end"] - b["end"]).otherwise(
        a["start"] - b["start"]))
    near = F.when(F.size("spans") > 0, _let(ordered, lambda spans: F.flatten(F.transform(spans, lambda s, i: _near(
        F.col("text"), s, F.slice(spans, F.greatest(i - NEIGHBOURS + 1, F.lit(1)), 2 * NEIGHBOURS + 1))))))
    return rows.select(F.monotonically_increasing_id().alias("row_no"), "key", "spans", near.alias("near"))


def disclosure(docs: DataFrame, found: DataFrame, text: str = "text", support: int = SUPPORT,
               bits: int = TERM_BITS) -> DataFrame:
    """(term, kind, value, n_both, n_term, n_value, disclosed) of pairs seen in ``support`` contexts or more."""
    pair = ["kind", "value", "term"]
    mentions = found.where(F.size("near") > 0).select("row_no", F.inline("near"))
    together = mentions.groupBy(*pair).agg(
        F.count_distinct("row_no").alias("n_both"), F.count_distinct("context").alias("contexts")).where(
        F.col("contexts") >= support)
    values = found.select("row_no", F.inline("spans")).groupBy("kind", "value").agg(
        F.count_distinct("row_no").alias("n_value"))
    # counted anew, without rows: pairs that are written have a file per partition, however few there are
    wanted = mentions.groupBy(*pair).agg(F.count_distinct("context").alias("contexts")).where(
        F.col("contexts") >= support).select("term").distinct()
    lower = F.transform(F.regexp_extract_all(F.col(text), F.lit(WORD_PATTERN), F.lit(0)), F.lower)
    said = docs.select(F.explode(F.array_distinct(lower)).alias("term"))
    said = in_filter(said, F.col("term"), bit_filter(wanted, "term", bits), bits, "wanted").where("wanted")
    terms = said.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    everything = found.agg(F.count(F.lit(1))).scalar()
    rows = together.join(terms, "term").join(values, ["kind", "value"])
    inside = F.log2(everything / F.col("n_value"))
    gained = F.log2(F.col("n_both") * everything / (F.col("n_term") * F.col("n_value")))
    return rows.select(*pair, "n_both", "n_term", "n_value", F.when(inside > 0, F.least(gained / inside, F.lit(1.0)))
                       .otherwise(0.0).alias("disclosed"))


def all_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", generalise: float = GENERALISE,
              remove: float = REMOVE) -> DataFrame:
    """One row per row of ``docs``: row_no, key, base (spans), spans (base and disclosing words, by kind, then start)."""
    found = staged(find(docs, key, text), "sanitise-found")
    strong = disclosure(docs, found, text).where(F.col("disclosed") >= generalise).select(
        "kind", "value", "term", F.when(F.col("disclosed") >= remove, KINDS.index("removed")).otherwise(
            KINDS.index("generalised")).alias("action"))
    near = found.where(F.size("near") > 0).select("row_no", F.inline("near"))
    # a word near two values takes the stronger action
    hits = near.join(strong, ["kind", "value", "term"]).groupBy("row_no", "start", "end", "term").agg(
        F.max("action").alias("kind"))
    hits = hits.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct(
        "kind", "start", "end", F.col("term").alias("value")))).alias("more"))
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    return found.join(hits, "row_no", "left").select(
        "row_no", F.col("key").alias(key), F.col("spans").alias("base"),
        F.concat("spans", F.coalesce("more", empty)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of spans, joined with commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind, digest of the base spans and all spans of each row."""
    found = all_spans(docs, key, text)
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {n})")).cast("bigint").alias(f"n_{kind}")
              for n, kind in enumerate(PATTERNS)]
    return found.select(key, *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """A text with its spans replaced: base kinds by their name, generalised words by <WORD>, removed ones by nothing."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in PATTERNS], F.lit("<WORD>"), F.lit(""))
    ordered = F.array_sort(spans, lambda a, b: a["start"] - b["start"])
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        shown = F.when(s["start"] >= acc["at"], F.element_at(names, s["kind"] + 1)).otherwise("")
        return F.struct(F.concat(acc["out"], gap, shown).alias("out"), F.greatest(s["end"], acc["at"]).alias("at"))

    return F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], F.substring(
        text, acc["at"] + 1, F.length(text))))
