"""Personal data: fixed patterns, and terms that the corpus shows to reveal what they protect.

The patterns give the protected entities. A term in a text with an entity discloses it as far
as seeing the term makes the entity likelier: with document counts over the whole corpus,
PMI(term; entity) is compared with the entity's own information IC(entity). Terms whose
ratio reaches `generalise_at` are replaced by a class of words, those that reach
`remove_at` go. Everything on this path is a DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._state import small_side, written

# The patterns of the contract. Possessive quantifiers and the look-behind
# change no match; they keep long runs of one class from being tried at each position.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}+|)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}+|)){3}$"
#: A text without a match of these has none of the kind: they are cheap to look for.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
KINDS = tuple(PATTERNS)
WORD = r"[\p{L}\p{N}]+"
SPAN = "array<struct<start:int,end:int,value:string>>"
#: Items of an array that are folded at once.
BLOCK = 256


@dataclass(frozen=True)
class Disclosure:
    """support: documents, copies among them, in which a term must meet an entity, anywhere in the text;
    or as many different contexts, if one document holds them.
    reach: code points on either side of an entity that are its context.
    generalise_at, remove_at: least PMI(term; entity) / IC(entity).
    term_chars: shortest term."""

    reach: int = 80
    support: int = 3
    generalise_at: float = 0.75
    remove_at: float = 0.95
    term_chars: int = 3


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _blocks(items: Column) -> Column:
    """An array in parts of BLOCK items."""
    last = F.greatest(F.floor((F.size(items) - 1) / BLOCK).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def _folded(items: Column, out: str, step) -> Column:
    """(at, out) after all items, from at 0 and an empty array of type `out`; step(at, item) gives the new at and what one item adds to out.

    By blocks: an array grows by copying, so one fold over many thousand items would copy them as often.
    """
    empty = F.expr(f"cast(array() as {out})")

    def fold(every: Column) -> Column:
        return F.aggregate(_blocks(every), F.struct(F.lit(0).alias("at"), empty.alias("out")), block)

    def block(a: Column, b: Column) -> Column:
        def item(x: Column, y: Column) -> Column:
            at, more = step(x["at"], y)
            return F.struct(at.cast("int").alias("at"), F.concat(x["out"], more).alias("out"))

        one = F.aggregate(b, F.struct(a["at"].alias("at"), empty.alias("out")), item)
        return _once(one, lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], r["out"]).alias("out")))

    return _once(items, fold)


def _positions(text: Column, pattern: str, keep) -> Column:
    """Array of (start, end, value) of the pattern's matches, by the lengths of what lies between them."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    both = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = at + x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0))
        return end, F.array(F.struct((at + x["gap"]).alias("start"), end.alias("end"), x["value"].alias("value")))

    return F.filter(_folded(both, SPAN, step)["out"], lambda x: x["value"].isNotNull() & keep(x["value"]))


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    each = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise((F.substring(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(digits, i, F.lit(1)).cast("int") * 2 / 10).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


KEEP = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(IP_PARTS),
    "card": lambda v: F.when(_digits(v).between(16, 19), _luhn(v)).otherwise(False),
    "phone": lambda v: _digits(v).between(8, 15),
}
def with_base_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df and a column __<kind> for each kind: array of (start, end, value), code points, end exclusive. Null text: empty."""
    out = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    for kind in KINDS:
        out = out.withColumn(f"__{kind}", F.when(F.col("__text").rlike(HINTS[kind]), _positions(F.col("__text"), PATTERNS[kind], KEEP[kind])).otherwise(F.expr(f"cast(array() as {SPAN})")))
    return out


def _named() -> Column:
    """Array of all base spans, with their entities."""
    named = lambda k: F.transform(F.col(f"__{k}"), lambda x: F.struct(F.concat(F.lit(f"{k}:"), F.lower(x["value"])).alias("entity"), x["start"].alias("start"), x["end"].alias("end")))
    return F.concat(*[named(k) for k in KINDS])


def _contexts(texts: DataFrame, rule: Disclosure) -> DataFrame:
    """(entity, term, context) for each term within reach of a base span."""

    def near(b: Column) -> Column:
        first = F.greatest(F.array_min(F.transform(b, lambda x: x["start"])) - rule.reach, F.lit(0))
        held = F.substring(F.col("__text"), first + 1, F.array_max(F.transform(b, lambda x: x["end"])) + rule.reach - first)
        before = lambda h, x: F.substring(h, F.greatest(x["start"] - rule.reach, F.lit(0)) - first + 1, F.least(x["start"], F.lit(rule.reach)))
        after = lambda h, x: F.substring(h, x["end"] - first + 1, F.lit(rule.reach))
        return _once(held, lambda h: F.transform(b, lambda x: F.struct(x["entity"].alias("entity"), before(h, x).alias("before"), after(h, x).alias("after"))))

    rows = texts.select(F.explode(F.flatten(F.transform(_blocks(F.col("spans")), near))).alias("c")).select("c.*")
    return rows.select("entity", F.xxhash64("entity", "before", "after").alias("context"), F.explode(F.array_union(_terms(F.col("before"), rule), _terms(F.col("after"), rule))).alias("term"))


def _terms(text: Column, rule: Disclosure) -> Column:
    """The different terms of a text, in lower case."""
    found = F.filter(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lambda v: F.length(v) >= rule.term_chars)
    return F.array_distinct(F.transform(found, F.lower))


def disclosing_terms(docs: DataFrame, texts: DataFrame, rule: Disclosure) -> DataFrame:
    """(entity, term, ratio) for the pairs whose PMI / IC reaches generalise_at. docs: with __text. texts: the written different texts that hold entities.

    All counts are documents over their whole texts: each text counts as often as it stands in the corpus.
    """
    n = docs.count()
    near = _contexts(texts, rule).distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= rule.support)
    near = written(near.select("entity", "term", F.lit(True).alias("near")), "pii-near")
    entity = texts.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("copies").alias("df_entity")).where(F.col("df_entity") < n)
    # An entity in fewer documents meets no term in more.
    entity = entity.join(small_side(near.select("entity", "near").distinct()), "entity", "left").where((F.col("df_entity") >= rule.support) | F.col("near")).select("entity", "df_entity")
    entity = written(entity, "pii-entities")
    met = texts.select("__text", "copies", F.explode("entities").alias("entity")).join(small_side(entity.select("entity")), "entity")
    joint = met.select("entity", "copies", F.explode(_terms(F.col("__text"), rule)).alias("term")).groupBy("entity", "term").agg(F.sum("copies").alias("df_both"))
    pairs = joint.join(small_side(near), ["entity", "term"], "left").where((F.col("df_both") >= rule.support) | F.col("near")).drop("near")
    pairs = written(pairs, "pii-pairs")
    # Counted by term before any join, so no row is made for each meeting of a document and a candidate.
    df_term = docs.select(F.explode(_terms(F.col("__text"), rule)).alias("term")).groupBy("term").agg(F.count("*").alias("df_term"))
    ratio = F.log2(F.col("df_both") * F.lit(float(max(n, 1))) / (F.col("df_term") * F.col("df_entity"))) / -F.log2(F.col("df_entity") / F.lit(float(max(n, 1))))
    return pairs.join(small_side(entity), "entity").join(df_term, "term").select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= rule.generalise_at)


def _words(texts: DataFrame, rule: Disclosure) -> DataFrame:
    """(__key, term, class, start, end) of all terms of texts(__key, __text), by the lengths of what lies before them."""
    text, pattern = F.col("__text"), F.lit(f"({WORD})")
    both = F.arrays_zip(F.transform(F.split(text, WORD, -1), F.length).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(1)).alias("value"))
    rows = texts.select("__key", F.posexplode(both).alias("at", "x")).select("__key", "at", "x.gap", "x.value")
    upto = Window.partitionBy("__key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(upto).cast("int"))
    of = F.when(F.col("value").rlike("^[0-9]+$"), "[NUMBER]").when(F.col("value").rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    return rows.where(F.length("value") >= rule.term_chars).select("__key", F.lower("value").alias("term"), of.alias("class"), (F.col("end") - F.length("value")).alias("start"), "end")


def find(df: DataFrame, text_col: str = "text", rule: Disclosure = Disclosure()) -> DataFrame:
    """df, a column __<kind> of spans for each kind, and __term: spans (start, end, action, class) of disclosing terms.

    Null and empty texts have no spans. Rows of df may repeat; equal texts get equal spans.
    A disclosing term is found wherever it stands in a text with its entity; terms that overlap a base span are left to it.
    Columns of df stay as they are.
    """
    docs = with_base_spans(df, text_col)
    some = docs.select("__text", _named().alias("spans")).where(F.size("spans") > 0).select(F.sha2("__text", 256).alias("__key"), "__text", "spans")
    texts = some.groupBy("__key").agg(F.count("*").alias("copies"), F.first("__text").alias("__text"), F.first("spans").alias("spans"))
    texts = written(texts.withColumn("entities", F.array_distinct(F.col("spans.entity"))), "pii-texts")
    flagged = written(disclosing_terms(docs, texts, rule), "pii-flagged")
    own = texts.select("__key", F.explode("entities").alias("entity")).join(small_side(written(flagged.select("entity").distinct(), "pii-disclosed")), "entity")
    own = written(own, "pii-own")
    words = _words(texts.join(small_side(own.select("__key").distinct()), "__key", "left_semi"), rule)
    spans = words.join(small_side(own), "__key").join(small_side(flagged), ["entity", "term"]).groupBy("__key", "start", "end", "class").agg(F.max("ratio").alias("ratio"))
    spans = spans.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.when(F.col("ratio") >= rule.remove_at, "remove").otherwise("generalise").alias("action"), "class"))).alias("__term"))
    spans = written(spans, "pii-spans").withColumnRenamed("__key", "__span_key")
    out = docs.join(small_side(spans), F.when(F.size(F.concat(*[f"__{k}" for k in KINDS])) > 0, F.sha2("__text", 256)) == F.col("__span_key"), "left").drop("__span_key")
    base = F.concat(*[F.col(f"__{k}") for k in KINDS])
    clear = F.filter(F.col("__term"), lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return out.withColumn("__term", F.coalesce(clear, F.expr("cast(array() as array<struct<start:int,end:int,action:string,class:string>>)")))


def sanitise(df: DataFrame, text_col: str = "text", rule: Disclosure = Disclosure()) -> DataFrame:
    """df with its text's entities replaced by [EMAIL] and so on, and disclosing terms by [NUMBER], [NAME] or [WORD], or by nothing.

    Null stays null. Where base spans of two kinds overlap, the first in order of start, then of length, is replaced and the rest of the other is cut.
    """
    found = find(df, text_col, rule)
    masked = lambda k: F.transform(F.col(f"__{k}"), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("put")))
    base = F.concat(*[masked(k) for k in KINDS])
    terms = F.transform(F.col("__term"), lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("less"), t["end"].alias("end"), F.when(t["action"] == "remove", "").otherwise(t["class"]).alias("put")))
    spans = F.array_sort(F.concat(base, terms))
    piece = "array<struct<start:int,end:int,put:string>>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        kept = F.array(F.struct(at.alias("start"), x["start"].alias("end"), x["put"].alias("put")))
        return F.greatest(at, x["end"]), F.when(x["start"] >= at, kept).otherwise(F.expr(f"cast(array() as {piece})"))

    def put(b: Column) -> Column:
        first = b[0]["start"]
        held = F.substring(F.col("__text"), first + 1, F.element_at(b, -1)["end"] - first)
        return _once(held, lambda h: F.array_join(F.transform(b, lambda p: F.concat(F.substring(h, p["start"] - first + 1, p["end"] - p["start"]), p["put"])), ""))

    clean = _once(_folded(spans, piece, step), lambda a: F.concat(F.array_join(F.transform(_once(a["out"], _blocks), put), ""), F.substring(F.col("__text"), a["at"] + 1, F.length("__text"))))
    out = found.withColumn("__clean", F.when(F.size(spans) > 0, clean).otherwise(F.col(text_col)))
    return out.select(*[F.col("__clean").alias(c) if c == text_col else F.col(c) for c in df.columns])


def report(df: DataFrame) -> DataFrame:
    """The query's columns for documents(doc_id, text)."""
    found = find(df.select("doc_id", "text"))
    line = lambda k: F.transform(F.col(f"__{k}"), lambda x: F.concat(F.lit(f"{k}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    base = F.concat(*[line(k) for k in KINDS])
    return found.select(
        "doc_id", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, line("term")), ",").alias("spans"),
        F.size("__term").cast("long").alias("n_term"),
    )
