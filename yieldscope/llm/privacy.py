"""Personal data in texts, and terms that would give it away: information-theoretic sanitisation.

Base spans (e-mail, ip, card, phone) are found by pattern and checked. Their values are
the protected entities. A term that stands near an entity discloses it to the degree

    log2(P(entity | term) / P(entity)) / log2(1 / P(entity))

    P(entity) = N_e / N,   P(entity | term) = (N_et + prior * P(entity)) / (N_t + prior)

where N counts documents: all, those with the entity, those with the term anywhere, those
with the term near the entity. The estimate given the term is drawn to P(entity) with the
weight of ``prior`` documents, so every pair is scored, whatever its count, and the degree
nears 1 as documents gather that have the term with the entity only. Terms near an entity
that disclose it to ``generalise`` or more become spans too: they are replaced by their
kind of word, or removed at ``remove`` or more.

Everything is DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldscope.session import scratch_path

# Patterns of the four kinds. Possessive, and begun only where a run of
# their characters begins (or the match before ended), so that long runs cost one pass.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
WORD = r"\p{L}[\p{L}\p{N}'-]{2,}"
#: Code points on either side of an entity that count as near.
NEAR = 120
#: Matches of a text that are gathered before a list of lists grows, so lists stay short.
_GATHER = 512


def places(text: Column, pattern: str) -> Column:
    """All leftmost matches that do not overlap: array of (start, end, hit), in code points."""
    hits = "array<struct<start:bigint,end:bigint,hit:string>>"
    none = F.expr(f"cast(array() as {hits})")
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda gap, hit: F.struct(F.length(gap).cast("bigint").alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.expr(f"cast(array() as array<{hits}>)").alias("done"), none.alias("now"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + x["gap"]
        end = begin + F.length(x["hit"])
        full = F.size(acc["now"]) >= _GATHER
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit")))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(
            end.alias("pos"), F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, one).otherwise(F.concat(acc["now"], one)).alias("now")))

    found = F.aggregate(parts, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))
    return F.when(text.rlike(pattern), found).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    each = F.transform(F.reverse(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0))),
                       lambda d, i: d.cast("int") * (F.lit(1) + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


VALID = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda hit: F.length(_digits(hit)).between(16, 19) & luhn(_digits(hit)),
    "phone": lambda hit: F.length(_digits(hit)).between(8, 15),
}


def base_spans(text: Column) -> Column:
    """Checked spans of all kinds, by kind and start: array of (kind, start, end, value)."""
    def of(kind: str, pattern: str) -> Column:
        good = F.filter(places(text, pattern), lambda x: VALID[kind](x["hit"]))
        return F.transform(good, lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["hit"]).alias("value")))

    return F.concat(*[of(kind, pattern) for kind, pattern in KINDS.items()])


def disclosures(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", generalise: float = 0.75,
                remove: float = 0.95, prior: float = 0.5, near: int = NEAR, keep_text: bool = True) -> DataFrame:
    """doc_id, text, base (kind, start, end, value) and terms (start, end, term, removed) of every row.

    Null texts are empty. Without entities there are no terms. Rows are told apart by
    their place in the table, so repeated ids, null ids and repeated rows are rows like
    others. Offsets are code points, ends exclusive. ``keep_text=False`` leaves the text
    out where nothing was found.
    """
    spark = documents.sparkSession
    path = scratch_path(spark, "privacy")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), whole.alias("text"))
    found = source.withColumn("base", base_spans(F.col("text"))).withColumn("row", F.monotonically_increasing_id())
    if not keep_text:
        found = found.withColumn("text", F.when(F.size("base") > 0, F.col("text")))
    found.write.parquet(f"{path}/found")
    found = spark.read.parquet(f"{path}/found")

    total = found.count()
    mentions = found.where(F.size("base") > 0).select("row", "text", "base", F.explode("base").alias("e")).select(
        "row", "base", F.concat_ws(":", "e.kind", "e.value").alias("entity"),
        F.length("text").alias("length"), F.greatest(F.col("e.start") - near, F.lit(0)).alias("from"),
        F.least(F.col("e.end") + near, F.length("text")).alias("to"), "text")
    context = mentions.withColumn("context", F.expr("substring(text, cast(from + 1 as int), cast(to - from as int))"))
    # a word cut off by the edge of the context is no word
    words = (context.select("row", "entity", "base", "length", "from", "to", F.explode(places(F.col("context"), WORD)).alias("w"))
             .where("(w.start > 0 or from = 0) and (from + w.end < to or to = length)")
             .select("row", "entity", "base", (F.col("from") + F.col("w.start")).alias("start"),
                     (F.col("from") + F.col("w.end")).alias("end"), F.lower("w.hit").alias("term"))
             .where(~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"])))
             .select("row", "entity", "term", "start", "end"))
    words.write.parquet(f"{path}/words")
    words = spark.read.parquet(f"{path}/words")
    joint = words.select("entity", "term", "row").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    entities = found.select("row", F.explode(F.array_distinct(F.transform(
        "base", lambda e: F.concat_ws(":", e["kind"], e["value"])))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    terms = (source.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("term"))
             .groupBy("term").agg(F.count("*").alias("n_t")))
    share = F.col("n_e") / F.lit(float(total))
    degree = F.log2((F.col("n_et") + prior * share) / ((F.col("n_t") + prior) * share)) / -F.log2(share)
    revealing = (joint.join(entities, "entity").join(terms, "term").where(F.col("n_e") < total)
                 .select("entity", "term", degree.alias("degree")).where(F.col("degree") >= generalise))
    spans = (words.join(revealing, ["entity", "term"]).groupBy("row", "start", "end", "term")
             .agg((F.max("degree") >= remove).alias("removed"))
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "term", "removed"))).alias("terms")))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,term:string,removed:boolean>>)")
    return found.join(spans, "row", "left").select("doc_id", "text", "base", F.coalesce("terms", none).alias("terms"))


def sanitised() -> Column:
    """The text of a row of ``disclosures`` with base spans named by kind, terms generalised or removed."""
    kept = F.concat(
        F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"),
                                               F.concat(F.lit("["), F.upper(b["kind"]), F.lit("]")).alias("word"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"),
                                                F.when(t["removed"], "").otherwise("[TERM]").alias("word"))))
    text = F.col("text")
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["pos"] + 1).cast("int"), (x["start"] - acc["pos"]).cast("int"))
        return F.when(x["start"] >= acc["pos"], F.struct(x["end"].alias("pos"), F.concat(acc["out"], gap, x["word"]).alias("out"))
                      ).otherwise(F.struct(F.greatest(x["end"], acc["pos"]).alias("pos"), acc["out"].alias("out")))

    return F.aggregate(F.array_sort(kept), start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), F.length(text))))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
