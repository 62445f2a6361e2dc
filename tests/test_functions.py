import pytest
from pyspark.sql import functions as F

from promptquarry.functions import text as T
from promptquarry.functions.porter import stem
from promptquarry.functions.regex import java, re2

STEMS = (
    "caresses→caress ponies→poni ties→ti cats→cat feed→feed agreed→agre plastered→plaster bled→bled motoring→motor sing→sing conflated→conflat "
    "troubled→troubl sized→size hopping→hop tanned→tan falling→fall hissing→hiss fizzed→fizz failing→fail filing→file happy→happi sky→sky "
    "relational→relat conditional→condit rational→ration valenci→valenc hesitanci→hesit digitizer→digit conformabli→conform radicalli→radic "
    "differentli→differ vileli→vile analogousli→analog vietnamization→vietnam predication→predic operator→oper feudalism→feudal "
    "decisiveness→decis hopefulness→hope callousness→callous formaliti→formal sensitiviti→sensit sensibiliti→sensibl triplicate→triplic "
    "formative→form formalize→formal electriciti→electr electrical→electr hopeful→hope goodness→good revival→reviv allowance→allow "
    "inference→infer airliner→airlin gyroscopic→gyroscop adjustable→adjust defensible→defens irritant→irrit replacement→replac "
    "adjustment→adjust dependent→depend adoption→adopt homologou→homolog communism→commun activate→activ angulariti→angular "
    "homologous→homolog effective→effect bowdlerize→bowdler probate→probat rate→rate cease→ceas controll→control roll→roll is→is as→as by→by 2024→2024"
)


@pytest.mark.parametrize("pair", STEMS.split())
def test_stems(pair):
    word, want = pair.split("→")
    assert stem(word) == want


def value(spark, f, *args):
    row = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args)))).select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first()
    return row["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("localhost:3000 localhost:30001 localhost:5432", "localhost:3000 localhost:<PORT> localhost:<PORT>"),
        ("path is /Users/example/project", "path is <USER_HOME>/project"),
        ("api_key=sk-12345abc", "api_key: <REDACTED>"),
        ("see src/a/b/c.ts", "see src<LOCAL_PATH>"),
        ("device: box7", "device: <MACHINE>"),
    ],
)
def test_sanitized(spark, text, want):
    assert value(spark, T.sanitized, text) == want


def test_boundaries_are_ascii(spark):
    assert value(spark, lambda c: T.matches(c, r"\btest\b"), "étest") is True
    assert re2(r"a\s") != r"a\s" and r"\b" not in java(r"\bx")


def test_wide_white_space(spark):
    assert value(spark, T.trimmed, " x\n") == "x"


@pytest.mark.parametrize(("text", "want"), [("", 0), ("abcd", 1), ("abcde", 2), ("hello world", 3)])
def test_token_estimate(spark, text, want):
    assert value(spark, T.token_estimate, text) == want


@pytest.mark.parametrize(("name", "want"), [("MultiEdit", "edit"), ("NotebookRead", "read"), ("WebSearch", "search"), ("Bash", "bash"), ("Task", "other")])
def test_tool_operation(spark, name, want):
    assert value(spark, T.tool_operation, name) == want


def test_jaccard(spark):
    df = spark.sql("SELECT array() :: array<string> AS e, array('a') AS a, array('a', 'b') AS b, array('b', 'c') AS c")
    assert tuple(df.select(T.jaccard(F.col("e"), F.col("e")), T.jaccard(F.col("a"), F.col("a")), T.jaccard(F.col("b"), F.col("c"))).first()) == (0.0, 1.0, 1 / 3)


def test_normalized_is_idempotent(spark):
    text = "Look AT https://x.y/z `code` now\n\n please"
    once = value(spark, T.normalized, text)
    assert once == "look at now please" and value(spark, T.normalized, once) == once


def test_trash_slug(spark):
    assert value(spark, T.trash_project, "My App 8.44.09 AM") == "trash:my-app"
    assert value(spark, T.trash_project, "!!!") == "trash:"


def test_null_texts(spark):
    assert value(spark, T.synthetic_for_labels, None) is True
    assert value(spark, T.synthetic_for_search, None) is True
    assert value(spark, T.has_vague_verb, None) is None
