"""Functions on texts of retrieval: sentences, overlapping chunks, stems, quantities and calendar terms that claims are checked
by. All are JVM expressions over arrays of tokens or sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters to a chunk.
CHUNK_CHARS = 420

# Words of scale, units with their kind and divisor, months, tolerances of agreement.
SCALES = {"trillion": 1e12, "t": 1e12, "billion": 1e9, "bn": 1e9, "b": 1e9, "million": 1e6, "mm": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}
UNITS = {"%": ("percent", 1.0), "percent": ("percent", 1.0), "bps": ("percent", 100.0), "basis points": ("percent", 100.0), "x": ("multiple", 1.0), "shares": ("count", 1.0), "people": ("count", 1.0), "positions": ("count", 1.0)}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
RELATIVE_TOLERANCE, POINT_TOLERANCE, LEAST_BARE = 0.015, 0.1, 32

#: A sentence's end and the beginning of the next: the text between them is one space.
SENTENCE_END, SENTENCE_BEGIN = r"[^0-9][.!?](?: ?\[[0-9]+\])*", r"[A-Z0-9\x22'(]"
TOKEN = r"\$?-?[0-9][0-9,]*(?:\.[0-9]+)?|%|[a-z]+"


def flat(text: Column) -> Column:
    """White space in runs of one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D ]+", " "))


def sentences(text: Column) -> Column:
    """Sentences: they end with a stop that follows no digit, and any citation marks, before a capital, digit, quote or bracket. Ends
    are marked twice, since an end may lie in the letter that begins a sentence."""
    marked = flat(text)
    for _ in range(2):
        marked = F.regexp_replace(marked, f"({SENTENCE_END}) ({SENTENCE_BEGIN})", "$1\n$2")
    return F.filter(F.split(marked, "\n"), lambda s: s != "")


def chunks(docs: DataFrame, key: str, text: str, target: int = CHUNK_CHARS) -> DataFrame:
    """Rows (key, ordinal, chunk): the sentences that begin in the same stretch of target characters, after the last sentence before
    them. Sentences of a row are placed by a running sum; rows with equal or null keys stay apart."""
    own = Window.partitionBy("row").orderBy("at")
    # The number is given before the sentences become rows.
    s = docs.select(F.col(key), sentences(F.col(text)).alias("all"), F.monotonically_increasing_id().alias("row")).select(key, "row", F.posexplode("all").alias("at", "sentence"))
    begin = F.sum(F.length("sentence") + 1).over(own) - F.length("sentence") - 1
    s = s.select(key, "row", "at", "sentence", F.floor(begin / target).alias("stretch"), F.lag("sentence").over(own).alias("before"))
    c = s.groupBy(key, "row", "stretch").agg(F.min_by("before", "at").alias("before"), F.array_sort(F.collect_list(F.struct("at", "sentence"))).alias("own"))
    ordinal = F.row_number().over(Window.partitionBy("row").orderBy("stretch")) - 1
    return c.select(key, ordinal.alias("ordinal"), F.concat_ws(" ", "before", F.transform("own", lambda x: x["sentence"])).alias("chunk"))


def stem(token: Column) -> Column:
    """The first step of Porter's algorithm (1980): plurals, then -eed, -ed and -ing after a part that has a vowel, with what is to be
    restored at the end."""
    vowel = "(?:[aeiou]|(?<=[^aeiou])y)"
    one = F.regexp_replace(F.regexp_replace(token, "(ss|i)es$", "$1"), "([^s])s$", "$1")
    bare = F.regexp_extract(one, f"^(.*{vowel}.*)(?:ed|ing)$", 1)
    restored = F.when(bare.rlike("(?:at|bl|iz)$"), F.concat(bare, F.lit("e"))).when(bare.rlike(r"([^aeioulsz])\1$"), bare.substr(F.lit(1), F.length(bare) - 1)).when(bare.rlike("^[^aeiou]+[aeiouy][^aeiouwxy]$"), F.concat(bare, F.lit("e"))).otherwise(bare)
    return F.when(one.endswith("eed"), F.regexp_replace(one, f"^(.*{vowel}[^aeiou].*)eed$", "$1ee")).when(bare != "", restored).otherwise(one)


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def quantities(text: Column) -> Column:
    """array<struct<value, kind>> of a text, read as tokens: a number, a scale if the next token is one, then a unit of one token or
    two. Bare whole numbers below LEAST_BARE are left out."""
    tokens = F.regexp_extract_all(F.regexp_replace(F.lower(flat(text)), r"\$ ", r"\$"), F.lit(f"({TOKEN})"))
    scales, kinds, divisors = _map(SCALES), _map({k: v[0] for k, v in UNITS.items()}), _map({k: v[1] for k, v in UNITS.items()})

    def read(t: Column) -> Column:
        numbers = F.filter(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].rlike("[0-9]"))

        def parse(s: Column) -> Column:
            scale = F.try_element_at(scales, F.get(t, s["i"] + 1))
            behind = s["i"] + F.when(scale.isNull(), 1).otherwise(2)
            two = F.concat_ws(" ", F.get(t, behind), F.get(t, behind + 1))
            unit = F.when(F.try_element_at(kinds, two).isNotNull(), two).otherwise(F.get(t, behind))
            kind = F.coalesce(F.try_element_at(kinds, unit), F.when(s["x"].startswith("$"), "currency").otherwise("bare"))
            value = F.regexp_replace(s["x"], "[$,]", "").cast("double") * F.coalesce(scale, F.lit(1.0)) / F.coalesce(F.try_element_at(divisors, unit), F.lit(1.0))
            return F.struct(value.alias("value"), kind.alias("kind"))

        return F.filter(F.transform(numbers, parse), lambda q: (q["kind"] != "bare") | (F.abs(q["value"]) >= LEAST_BARE) | (q["value"] != F.floor(q["value"])))

    # The tokens are one column's value of each step, not an expression repeated in it.
    return F.flatten(F.transform(F.array(tokens), read))


def agree(a: Column, b: Column) -> Column:
    """Kinds are equal or one is bare; values differ by RELATIVE_TOLERANCE of the greater at most, percentages by POINT_TOLERANCE."""
    gap, most = F.abs(a["value"] - b["value"]), F.greatest(F.abs(a["value"]), F.abs(b["value"]))
    kinds = (a["kind"] == b["kind"]) | (a["kind"] == "bare") | (b["kind"] == "bare")
    return kinds & ((gap <= RELATIVE_TOLERANCE * most) | (((a["kind"] == "percent") | (b["kind"] == "percent")) & (gap <= POINT_TOLERANCE) & (most > 0)))


def calendar_terms(text: Column) -> Column:
    """Quarters, fiscal years, days and periods relative to now, in lower case; a day written with its month's name becomes an ISO date."""
    plain = F.lower(flat(text))
    every = lambda pattern: F.regexp_extract_all(plain, F.lit(rf"\b({pattern})\b"))
    named = F.transform(every(rf"(?:{'|'.join(MONTHS)}) [0-9]{{1,2}},? [0-9]{{4}}"), lambda d: F.split(F.regexp_replace(d, ",", ""), " "))
    month = _map({m: f"{i:02}" for i, m in enumerate(MONTHS, 1)})
    days = F.transform(named, lambda p: F.concat_ws("-", p[2], F.element_at(month, p[0]), F.lpad(p[1], 2, "0")))
    periods = every("(?:next|last|prior|trailing) (?:twelve months|four quarters|quarter|year)")
    return F.array_distinct(F.concat(F.transform(every("q[1-4] ?[0-9]{4}"), lambda q: F.regexp_replace(q, " ", "")), every("fy ?[0-9]{2,4}|fiscal [0-9]{4}"), every("[0-9]{4}-[0-9]{2}-[0-9]{2}"), days, periods))


def claim_checks(claim: str, source: str) -> Column:
    """struct<numerical, temporal>: whether the source holds all quantities of the claim, and all its calendar terms; false for a claim
    without any."""
    def check(c: Column) -> Column:
        held = F.forall(c["asked"], lambda a: F.exists(c["given"], lambda g: agree(a, g)))
        return F.struct(((F.size(c["asked"]) > 0) & held).alias("numerical"), ((F.size(c["dates"]) > 0) & (F.size(F.array_except(c["dates"], c["known"])) == 0)).alias("temporal"))

    sides = F.struct(quantities(F.col(claim)).alias("asked"), quantities(F.col(source)).alias("given"), calendar_terms(F.col(claim)).alias("dates"), calendar_terms(F.col(source)).alias("known"))
    return F.transform(F.array(sides), check)[0]
