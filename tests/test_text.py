import hashlib
import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmill.functions import prompts
from textmill.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def many(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in rows.select("i", column.alias("x")).orderBy("i").collect()]


def hash_3gram(t):
    k = [w for w in re.sub("[^a-z0-9 ]+", " ", t.lower()).split(" ") if w]
    if len(k) < 3:
        return hashlib.sha1(" ".join(k).encode()).hexdigest()
    return hashlib.sha1(b"".join(hashlib.md5(" ".join(k[i : i + 3]).encode()).digest() for i in range(len(k) - 2))).hexdigest()


def test_norm_text(spark):
    assert many(spark, T.norm_text("t"), [" a \t\n b ", None, "", "x 　y\x1c", "\x85"]) == ["a b", "", "", "x y", ""]


def test_hash_3gram(spark):
    texts = ["A, b", "a b", "", "x y z", "The quick, brown fox. " * 50, "é ü", "one two three four"]
    got = many(spark, T.hash_3gram("t"), texts)
    assert many(spark, T.hash_3gram_native("t"), texts) == got
    assert got == [hash_3gram(t) for t in texts]
    assert got[0] == got[1] == hashlib.sha1(b"a b").hexdigest()


def test_chunks(spark):
    # Of 100 characters at most: an overlap of 10, so pieces start at 0, 90, 180.
    letters = "".join(chr(97 + i % 26) for i in range(250))
    got = many(spark, T.chunks("t", 100), [letters, letters[:185], letters[:100], "", "q"])
    assert got == [[letters[:100], letters[90:190], letters[180:]], [letters[:100], letters[90:185], letters[180:185]], [letters[:100]], [""], ["q"]]
    assert [len(x) for x in many(spark, T.chunks("t", 5000), ["x" * 10_000])[0]] == [5000, 5000, 400]


def test_nested_fields(spark):
    row = spark.range(1).select(F.expr("named_struct('a', 'x', 'n', 3, 'l', array('y', '', null))").alias("one"), F.expr("array(named_struct('t', 'p', 'n', 1), null, named_struct('t', 'q', 'n', 2))").alias("many"), F.expr("map('k', 'v', 'm', 'w')").alias("map"), F.expr("array(1, 2)").alias("numbers"), F.lit(7).alias("number"), F.expr("cast(null as string)").alias("none"))
    first = lambda *names: row.select(T.first_text(row, *names).alias("x")).first()["x"]
    assert [first("none", "one"), first("absent", "many"), first("map"), first("numbers", "number"), first("none")] == ["x\ny", "p\nq", "v\nw", "7", ""]


def test_cache_keys_differ(spark):
    rows = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a|b", None, None), ("a", "-", "b"), (None, "a", "b"), ("", "a", "b")], "x string, y string, z string")
    assert rows.select(T.cache_key("x", "y", "z").alias("k")).distinct().count() == 6


def test_json_bytes(spark):
    texts = ["plain", 'q"\\/', "\u0001\u001f\u007f \t", "é😀"]
    got = many(spark, T.json_bytes("t", F.lit("s")), texts)
    assert got == [len(json.dumps({"text": t, "source": "s"}, ensure_ascii=False).encode()) for t in texts]


def test_fields(spark):
    assert one(spark, T.coalesce_text("a", "b"), a="", b="t") == "t"
    assert one(spark, T.coalesce_text(("a", True), "b"), a=["x", "y"], b="t") == "x\ny"
    assert one(spark, T.concat_text("a", ("b", True), "c"), a=None, b=["x", ""], c="z") == "x z"


def test_extract_choice(spark):
    cases = {"Answer: B. Final answer - C": "C", "(A) or [D]": "D", "and": "D", "1, no 3": "C", "": "", None: "", "nothing 12": "", "option\nd)": "D", "33 4 x": "D"}
    assert many(spark, T.extract_choice("t"), list(cases)) == list(cases.values())


def test_other_parsers(spark):
    assert many(spark, T.extract_letter("t"), ["I say b.", "abc"]) == ["B", ""]
    assert many(spark, T.parse_yes_no("t"), [" Yes!", "NO", "maybe so", "hm", None]) == ["yes", "no", "maybe", "maybe", "maybe"]
    assert many(spark, T.parse_nli("t"), ["Entailment.", "contradiction", "x"]) == ["entailment", "contradiction", "neutral"]
    assert many(spark, T.parse_spans("t"), [" a \n\n b\r\nc", None]) == [["a", "b", "c"], []]
    assert many(spark, T.clip_at("t", ["\n\n", "END"]), ["abENDcd\n\nx"]) == ["ab"]
    assert many(spark, T.fill_empty("t", F.lit("z")), ["", None, "a"]) == ["z", "z", "a"]
    assert many(spark, T.normalize_entity("t"), [" A \n B "]) == ["a b"]
    assert many(spark, T.contains_any("t", T.TRANSIENT), ["Read timed OUT", "x", None]) == [True, False, False]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aAbBz \n\t.-1", max_size=40), min_size=1, max_size=20))
def test_naive_entities(spark, texts):
    assert many(spark, T.naive_entities("t"), texts) == [re.findall(r"[A-Za-z][a-z]+(?:\s+[A-Za-z][a-z]+)*", t) for t in texts]


def test_long_run_of_words(spark):
    assert len(many(spark, T.naive_entities("t"), ["word " * 100_000])[0]) == 1


def test_mcq_labels(spark):
    rows = spark.createDataFrame([(str(i), "q", "w", "x", "y", "Same  text.") for i in [0, 1, 3, 4, 5, "c", "same text"]], "answer string, question string, A string, B string, C string, D string")
    assert [r["gold"] for r in prompts.medqa(rows).collect()] == ["A", "B", "D", "D", "", "C", "D"]
    assert [r["gold"] for r in prompts.medmcqa(rows).collect()] == ["A", "B", "D", "D", "", "C", ""]
    assert "A) w\nB) x\n" in prompts.medqa(rows).first()["prompt"]


def test_naive_entities_take_no_lambda_for_each(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(T.naive_entities("t").alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "split" not in plan
    odd = ["Ab cd  Ef\x1cgh", "aB Cd", "Ab C Def", "  Ab ", "Ab" * 3, "Ab\n" * 50_000, "éab Cd"]
    assert many(spark, T.naive_entities("t"), odd) == [re.findall(T.ENTITY, t) for t in odd]
