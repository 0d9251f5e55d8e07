from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.functions import vectors as V
from lumenfold.plans import query as Q


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_have_stems_and_synonyms(spark):
    assert one(spark, T.tokens(F.lit("parseHTMLNodes running_jobs 42"))) == ["html", "job", "jobs", "node", "nodes", "parse", "run", "running", "runn"] or sorted(one(spark, T.tokens(F.lit("parseHTMLNodes running_jobs 42")))) == sorted(Q.tokens("parseHTMLNodes running_jobs 42", synonyms=False))
    for text in ("priority of mixed sources", "rank search results", "validation", "passing boxes", ""):
        assert one(spark, T.tokens(F.lit(text), synonyms=True)) == Q.tokens(text)


def test_intents_and_routes(spark):
    # expected routes of the reference's behaviour, by hand
    assert Q.parse("authenticateUser").route == "graph-first"
    assert Q.parse("how does auth work").route == "hybrid"
    assert Q.parse("path:src/api authenticate").route == "graph-first-filter"
    assert Q.parse("similar to token validation").route == "vector-first"
    parsed = Q.parse("kind:function lang:typescript path:src/api name:auth token validation")
    assert parsed.filters == {"kind": "function", "language": "typescript", "path": "src/api", "name": "auth"}
    assert parsed.text == "token validation"
    for text in ("authenticateUser", "how does auth work", "similar to token validation", "trace the callers", "stale files", "ClassA ClassB fooBar"):
        made = one(spark, Q.intent_column(F.lit(text)))
        assert made == Q.parse(text).intent, text
        assert one(spark, Q.route_column(F.lit(text), F.lit(made))) == Q.parse(text).route, text


def test_masking_replaces_the_first_match_only(spark):
    assert one(spark, T.masked(F.lit("v 1.2.3 and 4.5.6 in /home/ann"))) == "v [DYNAMIC] and 4.5.6 in [DYNAMIC]"


def test_redaction(spark):
    assert one(spark, T.redacted(F.lit("Bearer abc.def api_key=12345678"))) == "Bearer [REDACTED] api_key=[REDACTED]"


def test_vectors(spark):
    a, b, zero = (F.array(*map(F.lit, x)) for x in ([3.0, 4.0], [4.0, 3.0], [0.0, 0.0]))
    assert abs(one(spark, V.cosine(a, b)) - 0.96) < 1e-12
    assert one(spark, V.cosine(a, zero)) == 0.0


def test_rolling_hash(spark):
    value = 0
    for c in "abc":
        value = (value * 31 + ord(c)) & 0xFFFFFFFF
    assert one(spark, T.rolling_hash31(F.lit("abc"))) == f"{value:x}"
