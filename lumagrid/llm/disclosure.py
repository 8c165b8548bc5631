"""Personal data: patterns, and information-theoretic sanitisation of the terms that give it away. DataFrame operations only.

Patterns find emails, IP addresses, card and phone numbers; each found value is a protected entity. A term discloses an
entity by how much of the entity's information it carries: pointwise mutual information of term and entity over the
corpus, divided by the information content of the entity (1: whoever sees the term knows the entity). Both are smoothed
by half a document, so that an entity of a single document has terms too while small tables tell little. Co-occurrence
is counted over whole documents, outside of the values. Every occurrence of a term over the threshold, in documents that
hold the entity, is generalised to a placeholder when the text is sanitised; so are the values.

Positions are in code points. Patterns are written so that they run in linear time on long texts; each finds just what
its plain form finds. Time and memory of a row grow in proportion to its text and its spans.

Defined results: null and empty texts hold nothing; rows that agree in id and text share their spans; other columns are
never looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumagrid.llm.shared import fresh, saved, scratch

KINDS = ("email", "ip", "card", "phone")
#: A value may start where the last match ended or where no character of its kind stands before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}"
#: Share of an entity's information from which on a term discloses it, and documents that must show both.
DISCLOSES, SUPPORT = 0.9, 1
#: Items of a fold that grows an array, and code points of a piece of text.
CHUNK, PIECE = 256, 256
#: Terms and rows up to which they are broadcast.
SMALL = 200_000


def _literal(pattern: str) -> str:
    return "r'" + pattern + "'"


def find(text: str, pattern: str) -> str:
    """SQL for all matches of a pattern: array of (start, end, value), in code points.

    Gaps and matches are added up in chunks, and the chunks' places after that: arrays that grow by one at a time stay short.
    """
    p = _literal(pattern)
    items = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (gap, hit) -> struct(length(gap) as gap, hit))"
    step = """struct(s.at + x.gap + coalesce(length(x.hit), 0) as at,
        case when x.hit is null then s.found else array_append(s.found, named_struct('start', s.at + x.gap, 'end', s.at + x.gap + length(x.hit), 'value', x.hit)) end as found)"""
    chunk = f"aggregate(slice(i_, k * {CHUNK} + 1, {CHUNK}), struct(0 as at, cast(array() as array<struct<start:int,end:int,value:string>>) as found), (s, x) -> {step})"
    placed = "flatten(transform(c_, (c, k) -> transform(c.found, x -> named_struct('start', x.start + o_[k], 'end', x.end + o_[k], 'value', x.value))))"
    offsets = "aggregate(c_, array(0), (s, c) -> array_append(s, element_at(s, -1) + c.at))"
    return f"transform(array({items}), i_ -> transform(array(transform(sequence(0, cast((size(i_) - 1) div {CHUNK} as int)), k -> {chunk})), c_ -> transform(array({offsets}), o_ -> {placed})[0])[0])[0]"


def _valid(kind: str) -> str:
    """SQL condition on x.value."""
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": "forall(split(x.value, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(right(p, 3) as int) <= 255)",
        "card": f"""transform(array(reverse({digits})), d -> aggregate(sequence(1, length(d)), 0, (s, i) -> s + (case when i % 2 = 1 then cast(substr(d, i, 1) as int)
            else 2 * cast(substr(d, i, 1) as int) - 9 * cast(substr(d, i, 1) >= '5' as int) end)) % 10 = 0)[0]""",
        "phone": f"length({digits}) between 10 and 15",
    }[kind]


def base_spans(text: str = "text") -> Column:
    """array of (start, kind number, end, value) in order of start and kind."""
    parts = []
    for k, kind in enumerate(KINDS):
        hint = {"email": f"contains({text}, '@')", "phone": f"contains({text}, '+')"}.get(kind, "true")
        found = f"transform(filter({find(text, PATTERNS[kind])}, x -> {_valid(kind)}), x -> struct(x.start as start, {k} as kind, x.end as end, x.value as value))"
        parts.append(f"case when {hint} and rlike({text}, {_literal(PATTERNS[kind])}) then {found} else cast(array() as array<struct<start:int,kind:int,end:int,value:string>>) end")
    return F.expr(f"sort_array(concat({', '.join(parts)}))")


def _written(spans: str) -> str:
    """SQL for kind:start:end of each span, joined."""
    names = ", ".join(f"'{k}'" for k in (*KINDS, "term"))
    return f"concat_ws(',', transform({spans}, x -> concat(array({names})[x.kind], ':', cast(x.start as string), ':', cast(x.end as string))))"


def _replaced(text: str, spans: str, put: str) -> str:
    """SQL for a text with its spans (sorted by start) replaced: put is SQL for what comes in place of span x, the text being done up to place s.at.

    The text is cut into short pieces first, so that what stands between two spans is taken from a few of them, however
    far into the text; spans are done in chunks, which know how far the ones before them reach.
    """
    cut = f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"
    part = lambda a, b: f"array_join(transform(sequence(cast({a} div {PIECE} as int), cast(({b} - 1) div {PIECE} as int)), q -> substring(g_[q], greatest({a} - q * {PIECE}, 0) + 1, least({b} - q * {PIECE}, {PIECE}) - greatest({a} - q * {PIECE}, 0))), '')"
    between = lambda a, b: f"if({b} > {a}, {part(a, b)}, '')"
    step = f"struct(greatest(s.at, x.end) as at, concat(s.out, array({between('s.at', 'x.start')}, {put})) as out)"
    reach = f"aggregate(sequence(0, cast((size(p_) - 1) div {CHUNK} as int)), array(0), (s, k) -> array_append(s, greatest(element_at(s, -1), array_max(transform(slice(p_, k * {CHUNK} + 1, {CHUNK}), x -> x.end)))))"
    chunk = f"aggregate(slice(p_, k * {CHUNK} + 1, {CHUNK}), struct(r_[k] as at, cast(array() as array<string>) as out), (s, x) -> {step}).out"
    done = f"concat(array_join(flatten(transform(sequence(0, size(r_) - 2), k -> {chunk})), ''), {between('element_at(r_, -1)', f'length({text})')})"
    return f"if(size({spans}) = 0, {text}, transform(array({cut}), g_ -> transform(array({spans}), p_ -> transform(array({reach}), r_ -> {done})[0])[0])[0])"


def _masked(text: str, spans: str) -> str:
    """SQL for a text with its spans blanked, every other character at its place."""
    return _replaced(text, spans, "repeat(' ', x.end - greatest(s.at, x.start))")


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string"))
    return slim.select("doc_id", key.alias("key"), "text", base_spans().alias("base"))


#: SQL for the distinct terms of a text.
TERMS = f"array_distinct(transform(regexp_extract_all(text, {_literal(TERM)}, 0), x -> lower(x)))"
def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def disclosing_terms(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = DISCLOSES, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Base results of each row (doc_id, key, base), and spans of terms that give an entity of the text away (key, terms); rows that agree in id and text have one key."""
    with scratch(docs.sparkSession) as keep:
        kept = F.expr("size(base) > 0")
        rows = saved(_keyed(docs, doc, text).withColumn("text", F.when(kept, F.expr(_masked("text", "base")))))
        held = rows.drop("text")
        one = saved(rows.where(kept).groupBy("key").agg(F.first(F.struct("text", F.expr("array_distinct(transform(base, x -> lower(x.value)))").alias("entities"))).alias("x"), F.count("*").alias("m")).select("key", "m", "x.*"))
        total = held.count()

        def share(n_both) -> Column:
            """Share of the entity's information that the term carries; half a document is added to each cell of the two by two table."""
            n_entity = (F.col("n_entity") + 1) / (total + 2)
            return F.log((n_both + 0.5) / ((F.col("n_term") + 1) * n_entity)) / -F.log(n_entity)

        entity = one.select("key", "m", F.explode("entities").alias("entity"))
        n_entity = saved(entity.groupBy("entity").agg(F.sum("m").alias("n_entity")).where(F.col("n_entity") < total))
        entity = saved(entity.join(_small(n_entity), "entity"))
        term = saved(one.select("key", "m", F.explode(F.expr(TERMS)).alias("term")))

        # no term that is this much more frequent than the most frequent entity beside it can pass
        most = entity.groupBy("key").agg(F.max("n_entity").alias("most"))
        nearby = term.join(most, "key").groupBy("term").agg(F.sum("m").alias("n_held"), F.max("most").alias("most"))
        wanted = saved(nearby.where((F.col("n_held") + 1) * (1 - 1e-9) <= (F.col("most") + 0.5) * ((total + 2) / 2) ** (1 - threshold)).select("term", F.xxhash64("term").alias("w"), "n_held"))
        # counts are added up in the tasks first, so that no row for each word of each document is shuffled
        words = docs.select(F.col(text).alias("text")).select(F.explode(F.expr(f"transform({TERMS}, x -> xxhash64(x))")).alias("w"))
        counts = wanted.join(words.groupBy("w").agg(F.count("*").alias("n_all")), "w", "left")
        counts = saved(counts.select("term", F.expr("greatest(n_held, n_all)").alias("n_term")))

        pairs = term.join(_small(counts), "term").join(entity.drop("m"), "key").where(share(F.least("n_term", "n_entity")) >= threshold)
        pairs = saved(pairs.select("key", "m", "entity", "term", "n_entity", "n_term"))
        told = pairs.groupBy("entity", "term").agg(F.sum("m").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
        told = saved(told.where(F.col("n_both") >= support).where(share(F.col("n_both")) >= threshold).select("entity", "term"))
        found = saved(pairs.join(_small(told), ["entity", "term"], "left_semi").select("key", "term").distinct())
        keep(rows)
        words = one.join(_small(found.select("key").distinct()), "key", "left_semi").select("key", F.expr(f"inline({find('text', TERM)})")).withColumn("term", F.lower("value"))
        place = F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")
        terms = keep(words.join(_small(found), ["key", "term"]).groupBy("key").agg(F.sort_array(F.collect_list(place)).alias("terms")))
    return held, terms


def personal_data(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms; one row per row of docs."""
    held, terms = disclosing_terms(docs, doc, text, **options)
    base = "transform(base, x -> struct(x.start as start, x.kind as kind, x.end as end))"
    held = held.select("doc_id", "key", F.expr(base).alias("base"))
    some = held.where("size(base) > 0").join(terms, "key", "left")
    none = held.where("size(base) = 0").withColumn("terms", F.expr("cast(null as array<struct<start:int,kind:int,end:int>>)"))
    out = some.select("doc_id", "base", "terms").unionByName(none.select("doc_id", "base", "terms"))
    out = out.withColumn("all", F.expr("sort_array(concat(base, coalesce(terms, array())))"))
    return out.select("doc_id", *[F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(F.expr(_written("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_written("all")).alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"))


def sanitised(text: str, spans: str) -> str:
    """SQL for a text with its spans (start, kind, end; sorted) replaced by placeholders; what overlaps an earlier span is covered by it."""
    names = ", ".join(f"'[{k.upper()}]'" for k in (*KINDS, "term"))
    return _replaced(text, spans, f"if(x.start >= s.at, array({names})[x.kind], '')")


def sanitise(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with values and disclosing terms replaced in the text; null texts stay null, other columns as they are."""
    held, terms = disclosing_terms(docs, doc, text, **options)
    spans = held.where("size(base) > 0").dropDuplicates(["key"]).select("key", F.expr("transform(base, x -> struct(x.start as start, x.kind as kind, x.end as end))").alias("base")).join(terms, "key", "left")
    name, own = fresh(docs, "spans"), fresh(docs, "row_key")
    found = saved(spans.select(F.col("key").alias(own), F.expr("sort_array(concat(base, coalesce(terms, array())))").alias(name)))
    key = F.concat_ws(":", F.coalesce(F.col(doc).cast("long").cast("string"), F.lit("-")), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).cast("string"))
    joined = docs.withColumn(own, key).join(_small(found), own, "left")
    clean = F.when(F.col(name).isNull(), F.col(text)).otherwise(F.expr(sanitised(f"`{text}`", name)))
    return joined.withColumn(text, clean).select(*[F.col(f"`{c}`") for c in docs.columns])
