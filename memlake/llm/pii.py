"""Personal data: base expressions, and bootstrapped contextual extraction. All native.

Base spans (email, ip, card, phone) are the seeds. Instances are loose candidates: mail-like strings, also
such as `jane (at) host`, and runs of numbers with separators; one with a base match
within is a seed of that kind. Its lexical patterns are the word before it, and that word with the word
after it, each with its class (mail or number); its exact shape does not matter. (A word after alone says too little.) Seeds
give patterns their first scores, patterns score their instances and instances their
patterns, round by round, over the graph of distinct patterns and instances. Candidates that
touch no base span but stand in patterns of high confidence become spans of the pattern's kind.

A frequent word's pattern has very many instances: patterns are joined to them under `SALTS` salts,
so that no task holds all of one pattern's.

Expressions are written so that no text takes more than linear time: a run of an
expression's characters is entered at its start only, and is not given back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import checkpointed, table, text_key

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MAIL = rf"(?<!{LOCAL}){LOCAL}++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
NUMBER = r"(?<![A-Za-z0-9])[+(]{0,2}[0-9]++(?:[\x20()./-]{1,3}+[0-9]++){0,11}+(?![A-Za-z0-9])"
CANDIDATE = f"{MAIL}|{NUMBER}"
SALTS = 16
CHUNK = 128
SPAN = "array<struct<start:int,k:int,end:int>>"


def matches(text: Column, expression: str, when: Column) -> Column:
    """All matches of an expression, leftmost and apart; empty unless `when`."""
    return F.when(when, F.regexp_extract_all(text, F.lit(expression), F.lit(0))).otherwise(F.array().cast("array<string>"))


def placed(text: Column, found: Column, expression: str) -> Column:
    """Matches with their places in code points: the texts between matches say where each starts."""
    gaps = F.split(text, expression, -1)
    both = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), F.slice(gaps, F.lit(2), F.size(found)).alias("next"))
    kind = "array<struct<start:int,end:int,hit:string,gap:string,next:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(64)).alias("gap"), F.left(x["next"], F.lit(64)).alias("next"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    # arrays are appended to in chunks, so that a text of many matches isn't copied once a match
    chunks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))
    outer = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def chunk(acc: Column, c: Column) -> Column:
        own = F.aggregate(F.slice(both, c * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), zero["out"].alias("out")), step)
        return F.struct(own["at"].alias("at"), F.concat(acc["out"], F.array(own["out"])).alias("out"))

    return F.when(F.size(found) > CHUNK, F.flatten(F.aggregate(chunks, outer, chunk, lambda a: a["out"]))).when(F.size(found) > 0, F.aggregate(both, zero, step, lambda a: a["out"])).otherwise(zero["out"])


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def holds(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(hit, r"\."), lambda p: part(p) & (F.coalesce(F.when(part(p), F.ltrim(p, F.lit("0"))).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))


def _valid(found: Column, i: int, kind: str) -> Column:
    ok = F.filter(found, lambda x: holds(kind, x["hit"]))
    return F.transform(ok, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("k"), x["end"].alias("end")))


def base_spans(docs: DataFrame, text: Column) -> DataFrame:
    """`docs` with __base, the sorted base spans, and __tokens, the loose candidates with what stands before and after them."""
    df = docs.withColumn("__text", text).withColumn("__digit", F.col("__text").rlike("[0-9]"))
    t, digit = F.col("__text"), F.col("__digit")
    asks = {"email": F.contains(t, F.lit("@")), "ip": digit & F.contains(t, F.lit(".")), "card": digit, "phone": digit & F.contains(t, F.lit("+"))}
    df = df.withColumns({f"__m_{k}": matches(t, BASE[k], asks[k]) for k in KINDS} | {"__m_token": matches(t, CANDIDATE, digit | t.rlike(r"@|[(\[]at[)\]]"))})
    df = df.withColumns({f"__p_{k}": placed(t, F.col(f"__m_{k}"), BASE[k]) for k in KINDS} | {"__tokens": placed(t, F.col("__m_token"), CANDIDATE)})
    spans = [_valid(F.col(f"__p_{k}"), i, k) for i, k in enumerate(KINDS)]
    df = df.withColumn("__base", F.array_sort(F.concat(*spans)))
    return df.drop("__digit", *[f"__m_{k}" for k in (*KINDS, "token")], *[f"__p_{k}" for k in KINDS])


def instances(rows: DataFrame, shortest: int) -> DataFrame:
    """A row per candidate and pattern: key, start, end, token, class, side, word, kind (of the base match within it, if one holds, else null).

    Numbers have `shortest` digits at least. A pattern is a side (0 the word before, 1 the words before and after), lower-cased, and a class.
    """
    one = rows.select("key", F.explode("tokens").alias("x")).select("key", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.lower("x.hit").alias("token"), "x.gap", "x.next")

    def has(kind: str) -> Column:
        hit = F.regexp_extract("token", BASE[kind], 0)
        return (hit != "") & holds(kind, hit)

    kind = F.coalesce(*[F.when(has(k), F.lit(KINDS.index(k))) for k in ("email", "ip", "phone", "card")])
    mail = F.col("token").rlike(r"[@a-z]")
    df = one.where(mail | (F.length(F.regexp_replace("token", "[^0-9]", "")) >= shortest))
    before = F.regexp_extract(F.lower(F.rtrim("gap")), r"(\S{1,32})$", 1)
    after = F.regexp_extract(F.lower(F.ltrim("next")), r"^(\S{1,32})", 1)
    both = F.when(after != "", F.concat_ws(" ", before, after)).otherwise(F.lit(""))
    side = F.explode(F.when(before != "", F.array(F.struct(F.lit(0).alias("side"), before.alias("word")), F.struct(F.lit(1).alias("side"), both.alias("word")))))
    df = df.select("key", "start", "end", "token", F.when(mail, 0).otherwise(1).alias("class"), kind.alias("kind"), side.alias("p"))
    return df.select("key", "start", "end", "token", "class", "kind", "p.side", "p.word").where("word <> ''")


PATTERN = ["side", "word", "class"]


def to_instances(many: DataFrame, of_patterns: DataFrame) -> DataFrame:
    """`many` rows that have a token and a pattern, with what `of_patterns` says of it; a pattern's rows are spread over salts."""
    salted = of_patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(F.hash("token"), F.lit(SALTS))).join(salted, [*PATTERN, "salt"]).drop("salt")


def patterns(found: DataFrame, rounds: int, confidence: float, support: int) -> DataFrame:
    """Patterns with a kind that they are confident of: side, word, class, found, top.

    The graph joins distinct patterns of `support` distinct instances or more and their instances. A
    seed's score is 1 for its own kind. A pattern's score for a kind is its instances' mean score, with one
    instance of score 0 added; an instance's is that of its best pattern, a seed's stays.
    """
    kinds = range(len(KINDS))
    seed = [F.max(F.when(F.col("kind") == i, 1.0).otherwise(0.0)).alias(f"s{i}") for i in kinds]
    edge = found.groupBy(*PATTERN, "token").agg(*seed)
    often = edge.groupBy(*PATTERN).agg(F.count("*").alias("n"), *[F.sum(f"s{i}").alias(f"n{i}") for i in kinds]).where(F.col("n") >= support).drop("n")
    edge = checkpointed(to_instances(edge, often))
    own = edge.groupBy("token").agg(*[F.max(f"s{i}").alias(f"own{i}") for i in kinds])
    score = own.select("token", *[F.col(f"own{i}").alias(f"t{i}") for i in kinds])
    for n in range(rounds):
        p = edge.join(score, "token").groupBy(*PATTERN, *[f"n{i}" for i in kinds]).agg(*[(F.sum(f"t{i}") / (F.count("*") + 1)).alias(f"p{i}") for i in kinds])
        if n < rounds - 1:
            best = to_instances(edge.select(*PATTERN, "token"), p.select(*PATTERN, *[f"p{i}" for i in kinds])).groupBy("token").agg(*[F.max(f"p{i}").alias(f"p{i}") for i in kinds])
            is_seed = sum(F.col(f"own{i}") for i in kinds) > 0
            score = checkpointed(best.join(own, "token").select("token", *[F.when(is_seed, F.col(f"own{i}")).otherwise(F.col(f"p{i}")).alias(f"t{i}") for i in kinds]))
    top = F.greatest(*[F.when(F.col(f"n{i}") >= support, F.col(f"p{i}")).otherwise(F.lit(0.0)) for i in kinds])
    kind = F.coalesce(*[F.when((F.col(f"n{i}") >= support) & (F.col(f"p{i}") == F.col("top")), F.lit(i)) for i in kinds])
    return checkpointed(p.withColumn("top", top).where(F.col("top") >= confidence).select(*PATTERN, kind.alias("found"), "top"))


def find_pii(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 4, shortest: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data. Columns: id, k1, k2 (hashes of the text), base, spans: sorted arrays of (start, k, end), k a place in KINDS, places in code points.

    Null texts count as empty. Base spans are always kept; a candidate is a span only if it
    touches none, is mail-like or has `shortest` digits at least, and one of its patterns has `support`
    distinct seeds of a kind and reaches `confidence`; the surest pattern says the kind. One row per row of `docs`;
    null ids, repeated rows and other columns of any name do no harm.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2 = text_key(text)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    rows = base_spans(plain, F.col("text")).select("id", F.struct("k1", "k2").alias("key"), F.col("__base").alias("base"), F.col("__tokens").alias("tokens"))
    rows = checkpointed(rows)
    one = instances(rows.where(F.size("tokens") > 0), shortest)
    sure = patterns(one, rounds, confidence, support)
    # a text that several rows have gives its candidates once
    unseen = to_instances(one.where("kind is null").select("key", "start", "end", "token", *PATTERN).distinct(), sure)
    surest = F.min_by("found", F.struct(-F.col("top"), F.col("found")))
    new = unseen.groupBy("key", "start", "end").agg(surest.alias("k")).groupBy("key").agg(F.collect_set(F.struct("start", "k", "end")).alias("more"))
    out = rows.join(new.withColumnRenamed("key", "key2"), F.col("key") == F.col("key2"), "left")
    free = F.filter("more", lambda m: ~F.exists("base", lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"])))
    return out.select("id", F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2"), "base", F.array_sort(F.concat("base", F.coalesce(free, F.array().cast(SPAN)))).alias("spans"))


def said(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with every span of personal data replaced by <KIND>; spans that overlap are one, named after the first. Texts without spans stay as they are, all columns too, whatever their names."""
    found = find_pii(docs, id_col=id_col, text_col=text_col, **options).where(F.size("spans") > 0).select("k1", "k2", "spans").dropDuplicates(["k1", "k2"])
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col(f"row.`{text_col}`").cast("string")
    k1, k2 = text_key(F.coalesce(text, F.lit("")))
    df = row.join(found, (k1 == F.col("k1")) & (k2 == F.col("k2")), "left")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["k"])))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], apart).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate("spans", zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)))
    new = F.when(F.col("spans").isNull(), F.col(f"row.`{text_col}`")).otherwise(masked)
    return df.select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["k"] == i)).cast("long")
    return out.select(F.col("id").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
