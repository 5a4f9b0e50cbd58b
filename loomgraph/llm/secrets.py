"""Secret scans with character Markov models.

Base patterns give spans of three kinds.  The method adds spans of kind
``random``: long tokens that a first-order character model of random strings
explains better than one of ordinary identifiers, by log-likelihood ratio.
It judges tokens by themselves, so a secret that a base pattern also finds has
both spans, and one that no pattern knows is found too.  Both models are counted
from labelled samples; the ratio table has one entry a pair of characters,
whatever the size of the samples, and stands in the plan as a constant.
Everything else is built-in functions on one row: no shuffle, and work in
proportion to the text.

Positions come from the gaps between matches, so they count code points.

Cases: a null or empty text has no span, and the hash of the empty string;
repeated rows are scanned each; a null ``doc_id`` is a row like any other; spans
of one start stand in the order of kinds; a text, token or run of matches of any
length is read whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# The shortest run that counts is part of the pattern where a shorter run can't change a longer match.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
LOW, SIDE = 43, 80  # characters "+" to "z"
BLOCK = 256  # matches of a text whose ends are summed at once

# Words of the built-in identifier samples.
WORDS = (
    "account address amount array attribute balance batch block buffer build button cache callback catalog category channel child class client code "
    "column command comment commit config connection constant container content context control convert count create current customer data default "
    "delete description detail device directory display document domain element email enable encode entry error event example execute export factory "
    "feature field file filter folder format frame function global graph group handler header height history image import index initial input instance "
    "interface internal item language layout length level library limit list load local location logger manager mapping master matrix maximum member "
    "memory message method metric minimum model module monitor name network node normal number object offset operation option order output package page "
    "parameter parent parse partition path pattern payment position prefix previous process product profile project property provider query queue range "
    "record reference region register release remote render report request resource response result return root sample schema scope score script search "
    "section select sender sequence serial server service session setting shadow signal size snapshot source stack start state status storage stream "
    "string style subject summary support switch symbol system table target template test text thread title total trace transaction transform type "
    "update upload user utility validate value vector version view visible widget width window worker writer"
).split()


def builtin_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(text, random) labelled samples: ``n`` random strings and ``n`` ordinary identifiers."""
    words = F.split(F.lit(" ".join(WORDS)), " ")
    pick = lambda i: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(WORDS))) + 1).cast("int"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    style = F.col("id") % 6
    parts = F.array(*[pick(i) for i in range(4)])
    camel = F.array_join(F.transform(parts, F.initcap), "")
    plain = (
        F.when(style == 0, F.array_join(parts, "_"))
        .when(style == 1, camel)
        .when(style == 2, F.array_join(parts, "-"))
        .when(style == 3, F.upper(F.array_join(parts, "_")))
        .when(style == 4, F.concat(F.array_join(parts, "/"), F.lit("/"), (F.col("id") % 100).cast("string")))
        .otherwise(F.array_join(parts, ""))
    )
    coded = F.base64(F.unhex(digest))
    chance = (
        F.when(style < 2, coded)
        .when(style == 2, F.translate(coded, "+/=", "-_"))
        .when(style == 3, F.translate(coded, "+/=", ""))
        .when(style == 4, F.upper(F.substring(F.translate(coded, "+/=", ""), 1, 32)))
        .otherwise(F.substring(digest, 1, 40))
    )
    ids = spark.range(n)
    return ids.select(chance.alias("text"), F.lit(True).alias("random")).union(ids.select(plain, F.lit(False)))


def train(samples: DataFrame, smoothing: float = 0.3) -> list[int]:
    """Log-likelihood ratio, in hundredths, of each pair of characters (row by row), from (text, random)."""
    code = lambda i: F.ascii(F.substring(F.col("text"), i, F.lit(1))) - LOW
    each = samples.filter(F.length("text") > 1).select("random", "text", F.explode(F.sequence(F.lit(2), F.length("text"))).alias("i"))
    pairs = each.select("random", code(F.col("i") - 1).alias("a"), code(F.col("i")).alias("b")).filter(f"a between 0 and {SIDE - 1} and b between 0 and {SIDE - 1}")
    counts = pairs.groupBy("a", "b").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("p"))
    grid = samples.sparkSession.range(SIDE * SIDE).select((F.col("id") / SIDE).cast("int").alias("a"), (F.col("id") % SIDE).cast("int").alias("b"))
    row = Window.partitionBy("a")
    full = grid.join(counts, ["a", "b"], "left").fillna(0, ["r", "p"])
    log = lambda c: F.log((F.col(c) + smoothing) / (F.sum(c).over(row) + SIDE * smoothing))
    table = full.select("a", "b", F.round(100 * (log("r") - log("p"))).cast("int").alias("x"))
    return table.agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "x"))), lambda s: s["x"])).first()[0]


def _ends(steps: str) -> tuple[Column, Column]:
    """Running totals of an array column: first those before each block of ``BLOCK`` entries, then, by these (a column
    ``{steps}_before``), all of them.  Arrays are only ever appended to within a block, or once a block."""
    part = lambda b: F.slice(steps, b * BLOCK + 1, BLOCK)
    number = F.when(F.size(steps) > 0, F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>").alias("out")

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def closing(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out"))

    sums = F.transform(number, lambda b: F.aggregate(part(b), F.lit(0), lambda s, x: s + x))
    before = F.aggregate(sums, F.struct(F.lit(0).alias("at"), none), step, lambda acc: acc["out"])
    inner = F.zip_with(number, F.col(f"{steps}_before"), lambda b, at: F.aggregate(part(b), F.struct(at.alias("at"), none), closing, lambda acc: acc["out"]))
    return before, F.flatten(inner)


def _spans(ends: Column, whole: str, group: str, kind: int, least: int) -> Column:
    zipped = F.arrays_zip(ends.alias("end"), F.col(whole).alias("m"), F.col(group).alias("v"))
    long = F.filter(zipped, lambda x: F.length(x["v"]) >= least)
    return F.transform(long, lambda x: F.struct((x["end"] - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["m"].alias("token")))


def _found(rows: DataFrame, patterns: dict[str, tuple[str, int, int]]) -> DataFrame:
    """``rows`` with a column of spans (start, kind, end, token) for each name of ``patterns`` (pattern, group, least):
    matches whose group has at least ``least`` characters.  Columns are made in steps, so that each is made once."""
    first, second, third, spans = {}, {}, {}, {}
    for kind, (name, (pattern, group, least)) in enumerate(patterns.items()):
        hit = F.rlike("text", F.lit(pattern))
        none = F.array().cast("array<string>")
        first[f"_m_{name}"] = F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
        first[f"_g_{name}"] = F.when(hit, F.split("text", pattern, -1)).otherwise(none)
        first[f"_v_{name}"] = F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(none)
        second[f"_s_{name}"] = F.zip_with(F.slice(f"_g_{name}", 1, F.size(f"_m_{name}")), f"_m_{name}", lambda g, m: F.length(g) + F.length(m))
        third[f"_s_{name}_before"], ends = _ends(f"_s_{name}")
        spans[name] = _spans(ends, f"_m_{name}", f"_v_{name}", kind, least)
    for step in (first, second, third, spans):
        rows = rows.withColumns(step)
    return rows.select("doc_id", *patterns)


def ratio(token: Column, table: list[int]) -> Column:
    """Log-likelihood ratio of a token, in hundredths."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - LOW)
    n = F.size(codes) - 1
    steps = F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: F.coalesce(F.get(values, a * SIDE + b), F.lit(0)))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    line = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), line), ",")


def scan(docs: DataFrame, table: list[int], threshold: int = 1000, each: int = 25) -> DataFrame:
    """Spans of each document.  A token is ``random`` if its ratio reaches ``threshold`` hundredths, and
    ``each`` hundredths a character."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = _found(rows, {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 0), "hex": (HEX, 0, 0), "random": (TOKEN, 0, 0)})
    judged = F.filter("random", lambda m: ratio(m["token"], table) >= F.greatest(F.lit(threshold), each * F.length(m["token"])))
    rows = rows.withColumns({"base": F.concat("assign", "access", "hex"), "random": F.when(F.size("random") > 0, judged).otherwise(F.col("random"))})
    n = lambda c: F.size(c).cast("long")
    return rows.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "random")).alias("spans"), n("random").alias("n_random"))
