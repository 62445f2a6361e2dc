"""Secret scan with DataFrame functions only.

Three fixed patterns give the base spans. The method adds spans of high entropy: candidates are long runs of
base64-like characters; along each the Shannon entropy of a sliding window is kept up to date by one count per
character, of which each step changes two, and a candidate is reported where its best window passes the
threshold of its character class, unless an allow-list of harmless forms suppresses it.

Defined cases: a null or empty text gives counts of 0 and empty span lists; spans are in code points with an
exclusive end; overlapping spans of different kinds are all reported; repeated rows are rows of their own; an empty
table gives an empty result; other columns are ignored. A text may be one long candidate or hold very many matches: work
grows with its length, and no pattern recurses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_VALUE = 6

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least bits of the best window per class; a window of 20 characters has at most 4.32. Runs of letters count as alnum.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: A word of one case, or a capitalised one; other mixtures of case are judged by their entropy.
WORD = r"(?:[A-Z][a-z]+|[A-Z]+|[a-z]+)"


def _allowed(repeated: str) -> tuple[str, ...]:
    """Forms that look random and are no secrets: UUIDs, words or snake/kebab names without digits, plain numbers, paths of
    words. repeated: what repeats a group. Java walks a possessive one in a loop, a plain one by recursion, which a long
    text ends; separators and words have no character in common, so both match the same."""
    return (
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
        rf"^[/_=+-]*{WORD}(?:[/_=+-]+{WORD}){repeated}[/_=+-]*$",
        r"^[0-9/_=+-]+$",
        rf"^{WORD}(?:[/_-]{WORD}){repeated}[/_=-]*[0-9]{{1,6}}$",
    )


#: As any engine reads them, and as Java's should.
ALLOWED, ALLOWED_JAVA = _allowed("*"), _allowed("*+")
CHUNK = 128
_PLACES = "array<struct<start:int,value:string>>"


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of the leftmost non-overlapping matches: the pieces between them give the places.
    Texts without a match cost one search. Places are summed in chunks of CHUNK matches, then inside each chunk, as a list
    that grows by one match at a time is copied at every step."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("value"))

    def place(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda i: F.slice(pairs, i * CHUNK + 1, F.lit(CHUNK)))
        return let(chunks, place_chunks)

    def place_chunks(chunks: Column) -> Column:
        length = lambda chunk: F.aggregate(chunk, F.lit(0), lambda at, x: at + x["gap"] + F.length(x["value"]))
        starts = F.aggregate(
            chunks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, chunk: F.struct((acc["at"] + length(chunk)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )
        return F.flatten(F.transform(F.arrays_zip(starts.alias("start"), chunks.alias("chunk")), lambda x: within(x["start"], x["chunk"])))

    def within(start: Column, chunk: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(start.alias("at"), F.array().cast(_PLACES).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + F.length(x["value"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), x["value"].alias("value")))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    return F.when(text.rlike(pattern), let(pairs, place)).otherwise(F.array().cast(_PLACES))


def spans(found: Column, kind: str) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (m["start"] + F.length(m["value"])).alias("end")
        ),
    )


def _term(count: Column) -> Column:
    """c log2 c, 0 for 0."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def best_entropy(value: Column, width: int = WINDOW) -> Column:
    """Most bits per character of any window of so many characters of ALPHABET. A count per character is kept: at each step
    the entering one's grows and the leaving one's falls, and the sum of c log2 c over the counts c changes by the terms of
    these two only. So the work grows with the length of the value, not with its square."""
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    leaving = F.slice(F.concat(F.array_repeat(F.lit(0), width), codes), F.lit(1), F.greatest(F.size(codes), F.lit(0)))

    def step(acc: Column, x: Column) -> Column:
        counts, enters, leaves = acc["counts"], x["enters"], x["leaves"]
        n_out = F.when(leaves > 0, F.get(counts, leaves))
        n_in = F.get(counts, enters) - F.when(enters == leaves, 1).otherwise(0)
        total = acc["sum"] - F.coalesce(_term(n_out) - _term(n_out - 1), F.lit(0.0)) + _term(n_in + 1) - _term(n_in)
        changed = F.transform(counts, lambda c, i: c + F.when(i == enters, 1).otherwise(0) - F.when((i == leaves) & (i > 0), 1).otherwise(0))
        left = acc["left"] - 1
        return F.struct(
            changed.alias("counts"), total.alias("sum"), left.alias("left"), F.when(left <= 0, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least")
        )

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(width).alias("left"), F.lit(1e9).alias("least"))
    steps = F.arrays_zip(codes.alias("enters"), leaving.alias("leaves"))
    return F.aggregate(steps, start, step, lambda acc: F.log2(F.lit(float(width))) - acc["least"] / width)


def char_class(value: Column) -> Column:
    return F.when(value.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(value.rlike(r"^[A-Za-z0-9]+$"), "alnum").otherwise("base64")


def is_secret(value: Column) -> Column:
    kind = char_class(value)
    least = F.when(kind == "hex", THRESHOLDS["hex"]).when(kind == "alnum", THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
    allowed = F.lit(False)
    for form in ALLOWED_JAVA:
        allowed = allowed | value.rlike(form)
    return F.when(allowed, False).otherwise(F.round(best_entropy(value), 9) >= least)


def joined(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with __assign, __access, __hex, __entropy: array<struct<start, rank, end>>."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    value = lambda m: F.regexp_extract(m["value"], ASSIGN, 1)
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(value(m)) >= LEAST_VALUE)
    entropy = F.filter(matches(text, CANDIDATE), lambda m: is_secret(m["value"]))
    return docs.withColumns(
        {
            "__assign": spans(assign, "assign"),
            "__access": spans(matches(text, ACCESS), "access"),
            "__hex": spans(matches(text, HEX), "hex"),
            "__entropy": spans(entropy, "entropy"),
        }
    )


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    base = F.concat("__assign", "__access", "__hex")
    return found.select(
        "doc_id",
        F.size("__assign").cast("long").alias("n_assign"),
        F.size("__access").cast("long").alias("n_access"),
        F.size("__hex").cast("long").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, F.col("__entropy"))).alias("spans"),
        F.size("__entropy").cast("long").alias("n_entropy"),
    )
