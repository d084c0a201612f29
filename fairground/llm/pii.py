"""Personal data: spans by pattern, and terms that the corpus shows to give such data away. Columns only.

The second part is information-theoretic: a term t discloses a protected value e as far as its pointwise
mutual information with e comes near the information of e itself. What is left, -log2 P(e|t), is
estimated from how many documents hold t near e and how many hold t at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairground.llm.common import named, scratch, whole

#: Kinds in the order of the result. Possessive forms and the look-behind keep the patterns linear in
#: the text; they match what the plain forms match, leftmost and non-overlapping.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: A term is sensitive if it leaves at most so many bits of the value's information, and at most that share
#: of it: it is removed up to LEFT_BITS, and generalised to its first letter up to VAGUE_BITS. Estimates
#: hold DOUBT of a text without the value: a term in one text is no evidence, two are.
LEFT_BITS, VAGUE_BITS, DOUBT = 0.25, 0.75, 1 / 3
#: Texts with a term from which on it may be generalised: fewer say too little of so weak a tie.
VAGUE_TEXTS = 4
#: One in so many texts, by their hash, bounds from below how many hold a term.
SLICES = 16
#: Rows and bytes up to which a table of terms or of texts is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_IP)
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _protected(kind: str, match: Column) -> Column:
    """One form for all spellings of a value."""
    return F.concat(F.lit(f"{kind}:"), F.lower(match) if kind in ("email", "ip") else _digits(match))


def _cut(rows: DataFrame, kind: str, pattern: Column, present: Column) -> DataFrame:
    """rows with `<kind>_m`, the matches, and `<kind>_p`, the pieces of text before, between and after
    them; both empty without a match."""
    none = F.array().cast("array<string>")
    rows = rows.withColumn(f"{kind}_m", F.when(present, F.regexp_extract_all("text_", pattern, F.lit(0))).otherwise(none))
    return rows.withColumn(f"{kind}_p", F.when(F.size(f"{kind}_m") > 0, F.split("text_", pattern, -1)).otherwise(none))


def _spans(kind: str, pieces: Column, matches: Column) -> Column:
    """start and end (code points, end exclusive) of every match, in order, and whether it is valid."""
    steps = F.transform(matches, lambda m, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("size"), _valid(kind, m).alias("valid")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        start, end = state["at"] + x["gap"], state["at"] + x["gap"] + x["size"]
        out = F.when(x["valid"], F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(steps, empty, step)["out"]).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _with_matches(rows: DataFrame) -> DataFrame:
    """rows (with `text_`, never null) and for every kind its matches and pieces."""
    text = F.col("text_")
    present = {"email": F.contains(text, F.lit("@")), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+"))}
    for kind, pattern in PATTERNS.items():
        rows = _cut(rows, kind, F.lit(pattern), present[kind])
    return rows


def _terms(text: Column) -> Column:
    """The different runs of letters of a text, of any length."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{L}++"), F.lit(0)))


def _without_emails(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)


def _value(kind: str):
    """Of a match: its protected form, and whether it is valid."""
    return lambda m: F.struct(_protected(kind, m).alias("entity"), _valid(kind, m).alias("valid"))


def _holders(rows: DataFrame) -> DataFrame:
    """entity, h: every valid value and the texts that hold it, each once."""
    every = [F.filter(F.transform(f"{kind}_m", _value(kind)), lambda x: x["valid"]) for kind in PATTERNS]
    some = F.greatest(*[F.size(f"{kind}_m") for kind in PATTERNS]) > 0
    return rows.where(some).select("h", F.inline(F.concat(*every))).select("entity", "h").distinct()


def _marked(kind: str):
    return lambda m: F.when(_valid(kind, m), F.lit(f"[{kind.upper()}]")).otherwise(m)


def _small(terms: DataFrame, columns: list[str]):
    """How to join a table of terms: broadcast only if its measured rows and bytes are few."""
    size = F.coalesce(F.sum(sum((F.octet_length(c) for c in columns), F.lit(16))), F.lit(0))
    rows, used = terms.agg(F.count("*"), size).first()
    return rows, (F.broadcast if rows <= BROADCAST_ROWS and used <= BROADCAST_BYTES else lambda x: x.hint("merge"))


def sensitive_terms(docs: DataFrame, text_col: str = "text", left_bits: float = LEFT_BITS, vague_bits: float = VAGUE_BITS) -> DataFrame:
    """term, entity, near, documents, left_bits, gain_bits, removed: the terms that give a value away, and
    whether so clearly that they are removed (else generalised).

    Counts are of whole and different texts: with the term and the value, with the term, with the value.
    Wherever a term stands in the texts of a value, it is a candidate."""
    text = F.coalesce(named(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(text.alias("text_"), F.xxhash64(text).alias("h"))
    holders = scratch(_holders(_with_matches(rows)), "holders")
    total = rows.select("h").distinct().count()
    entities = holders.groupBy("entity").agg(F.count("*").alias("with_entity"))
    # what a term may leave: of a value with less than one bit of its own, the same share of that
    entities = entities.withColumn("own_bits", F.log2(F.lit(float(total)) / F.col("with_entity")))
    entities = entities.withColumn("allowed", F.lit(max(left_bits, vague_bits)) * F.least(F.lit(1.0), "own_bits"))
    left = lambda together, documents: F.log2((documents + F.lit(DOUBT)) / together)
    share = left_bits / max(left_bits, vague_bits)

    def may_pass(together: Column, documents: Column, allowed: Column) -> Column:
        """Whether a term of at least so many texts, of them at most so many with the value, can be sensitive
        (to be generalised, it takes the fewest texts for that)."""
        return (left(together, documents) <= share * allowed) | (left(together, F.greatest(documents, F.lit(VAGUE_TEXTS))) <= allowed)

    # values for which no term can pass go: none leaves less than one that stands in just their texts
    entities = scratch(entities.where(may_pass(F.col("with_entity"), F.col("with_entity"), F.col("allowed"))), "entities")
    most, widest = entities.agg(F.max("with_entity"), F.max("allowed")).first()
    none = docs.sparkSession.createDataFrame([], "term string, entity string, near double, documents double, left_bits double, gain_bits double, removed boolean")
    if most is None:
        return none
    wanted = scratch(holders.join(entities.hint("merge"), "entity"), "wanted")
    texts = wanted.select("h").distinct()
    _, small = _small(texts, [])
    near_words = rows.join(small(texts), "h", "left_semi").select("h", F.explode(_terms(_without_emails(F.col("text_")))).alias("term"))
    near_words = scratch(near_words.distinct(), "near_words")
    # a term that a slice of the texts already holds too often can't pass, however many more hold it, nor one that too
    # few texts with a value hold
    in_texts = scratch(near_words.groupBy("term").agg(F.count("*").alias("in_texts")), "in_texts")
    _, small = _small(in_texts, ["term"])
    part = rows.where(F.pmod("h", F.lit(SLICES)) == 0).select("h", F.explode(_terms(_without_emails(F.col("text_")))).alias("term"))
    part = part.join(small(in_texts.select("term")), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("in_slice"))
    bound = in_texts.join(part.hint("merge"), "term", "left").withColumn("least", F.greatest("in_texts", "in_slice"))
    bound = scratch(bound.where(may_pass(F.least("in_texts", F.lit(most)), F.col("least"), F.lit(widest))).select("term", "least"), "bound")
    _, small = _small(bound, ["term"])
    met = near_words.join(small(bound), "term").join(wanted.hint("merge"), "h")
    pairs = met.groupBy("entity", "term").agg(F.count("*").alias("near"), *(F.first(c).alias(c) for c in ("least", "own_bits", "allowed")))
    pairs = scratch(pairs.where(may_pass(F.col("near"), F.col("least"), F.col("allowed"))).drop("least"), "pairs")
    candidates = pairs.select("term").distinct()
    held, small = _small(candidates, ["term"])
    if held == 0:
        return none
    words = rows.select("h", F.explode(_terms(_without_emails(F.col("text_")))).alias("term")).join(small(candidates), "term", "left_semi")
    documents = words.distinct().groupBy("term").agg(F.count("*").alias("documents"))
    scored = pairs.join(documents, "term").withColumn("left_bits", left(F.col("near"), F.col("documents")))
    scored = scored.withColumn("removed", F.col("left_bits") <= share * F.col("allowed"))
    kept = scored.where(F.col("removed") | ((F.col("left_bits") <= F.col("allowed")) & (F.col("documents") >= VAGUE_TEXTS)))
    return kept.select("term", "entity", F.col("near").cast("double").alias("near"), F.col("documents").cast("double").alias("documents"), "left_bits", (F.col("own_bits") - F.col("left_bits")).alias("gain_bits"), "removed")


def _term_pattern() -> Column:
    return F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, **thresholds) -> DataFrame:
    """row (a struct of the columns in keep), `text_`, the matches and pieces of every kind, `<kind>_s`,
    its spans (the kind `term`: occurrences of sensitive terms outside of the other spans), and `vague`,
    the terms to be generalised rather than removed.

    Null text counts as empty. Rows come as often as they are in the table, whatever their other
    columns hold or are called; an empty table gives no rows."""
    text = F.coalesce(named(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(whole(docs, keep or [text_col]).alias("row"), text.alias("text_"), F.xxhash64(text).alias("h_"))
    terms = scratch(sensitive_terms(docs, text_col, **thresholds), "sensitive")
    held = terms.groupBy("term").agg(F.bool_or("removed").alias("removed"))
    n, small = _small(held, ["term"])
    none = F.array().cast("array<string>")
    if n:
        hits = rows.select("h_", F.explode(_terms(_without_emails(F.col("text_")))).alias("term")).join(small(held), "term")
        hits = hits.groupBy("h_").agg(F.sort_array(F.collect_set("term")).alias("terms"), F.collect_set(F.when(~F.col("removed"), F.col("term"))).alias("vague"))
        hits = scratch(hits, "hits")
        rows_held, used = hits.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.coalesce(F.sum(F.octet_length(F.array_join("terms", ","))), F.lit(0))).first()
        few = rows_held <= BROADCAST_ROWS and used <= BROADCAST_BYTES
        rows = rows.join(F.broadcast(hits) if few else hits.hint("merge"), "h_", "left")
        rows = _cut(rows, "term", _term_pattern(), F.col("terms").isNotNull())
    else:
        rows = rows.withColumn("terms", F.lit(None).cast("array<string>")).withColumn("vague", none).withColumn("term_m", none).withColumn("term_p", none)
    rows = _with_matches(rows)
    for kind in [*PATTERNS, "term"]:
        rows = rows.withColumn(f"{kind}_s", _spans(kind, F.col(f"{kind}_p"), F.col(f"{kind}_m")))
    base = F.concat(*[F.col(f"{k}_s") for k in PATTERNS])
    apart = F.filter("term_s", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return rows.withColumn("term_s", F.when(F.size("term_s") > 0, apart).otherwise(F.col("term_s")))


def _listed(kind: str) -> Column:
    return F.transform(f"{kind}_s", lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of spans of each kind, base_sha256, spans, n_term of every row.

    Defined for all input as find() is; a null id stays null."""
    found = find(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), "text", ["doc_id"])
    found = found.withColumn("doc_id", F.col("row.doc_id"))
    base = F.array_join(F.concat(*[_listed(k) for k in PATTERNS]), ",")
    every = F.array_join(F.concat(*[_listed(k) for k in [*PATTERNS, "term"]]), ",")
    return found.select(
        "doc_id", *(F.size(f"{k}_s").cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"), F.size("term_s").cast("long").alias("n_term"),
    )


_MARKS = rf"\[(?:{'|'.join(kind.upper() for kind in PATTERNS)})\]"


def sanitise(docs: DataFrame, text_col: str = "text", out_col: str = "sanitised", **thresholds) -> DataFrame:
    """All columns of docs and out_col: the text with every value generalised to its kind, `[EMAIL]`,
    and, outside of these marks, every sensitive term removed, `[TERM]`, or generalised to its first
    letter, `[Q.]`. Kinds are replaced one after another, each in what the ones before have left. Null
    texts stay null; out_col replaces a column of its name; everything else is as in find()."""
    names = docs.columns
    found = find(docs, text_col, names, **thresholds).withColumn("now_", F.col("text_"))

    def replaced(rows: DataFrame, pattern: Column, some: Column, mark) -> DataFrame:
        rows = rows.withColumn("m_", F.when(some, F.regexp_extract_all("now_", pattern, F.lit(0))))
        pairs = F.zip_with(F.split("now_", pattern, -1), F.concat(F.transform("m_", mark), F.array(F.lit(""))), lambda p, m: F.array(p, m))
        return rows.withColumn("now_", F.when(F.size("m_") > 0, F.array_join(F.flatten(pairs), "")).otherwise(F.col("now_")))

    for kind, pattern in PATTERNS.items():
        found = replaced(found, F.lit(pattern), F.size(f"{kind}_m") > 0, _marked(kind))
    vague = lambda m: F.array_contains(F.coalesce("vague", F.array().cast("array<string>")), m)
    term = lambda m: F.when(m.rlike(f"^{_MARKS}$"), m).when(vague(m), F.concat(F.lit("["), F.left(m, F.lit(1)), F.lit(".]"))).otherwise("[TERM]")
    found = replaced(found, F.concat(F.lit(_MARKS + "|"), _term_pattern()), F.size("term_m") > 0, term)
    own = lambda c: F.col("row.`" + c.replace("`", "``") + "`")
    kept = [own(c).alias(c) for c in names if c != out_col]
    original = own(text_col)
    return found.select(*kept, F.when(original.isNotNull(), F.col("now_")).alias(out_col))
