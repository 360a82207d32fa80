"""YAML documents that no loader should fail on."""

import json

from pyspark.sql import functions as F

from tidewater.functions.documents import parse_document

BOMB = "a: &a [x, x, x, x, x, x, x, x, x]\n" + "\n".join(f"{n}: &{n} [{', '.join(['*' + p] * 9)}]" for p, n in zip("abcdefgh", "bcdefghi"))
DOCS = {
    "2024-01-01: x": {"2024-01-01": "x"},
    "when: 2024-01-01": {"when": "2024-01-01"},
    "a: &a [*a]": None,
    "a: .nan\nb: .inf": {"a": "nan", "b": "inf"},
    "base: &b {x: 1}\none: *b\ntwo: *b": {"base": {"x": 1}, "one": {"x": 1}, "two": {"x": 1}},
    "? [1, 2]\n: x": None,
    "2: one\ntrue: yes\n~: none\n2.5: x": {"2": "one", "true": True, "null": "none", "2.5": "x"},
    "a: [unclosed": None,
    "a: !!python/object:os.system x": None,
    "when: 2024-13-45": {"when": "2024-13-45"},
    "s: !!set {a, b}": None,
    "data: !!binary aGk=": {"data": "hi"},
    "": None,
    '{"a": 1}': {"a": 1},
    BOMB: None,
    "[" * 5000: None,
}


def test_no_document_ends_the_job(spark):
    texts = [*DOCS, None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").repartition(3)
    out = {r.k: r.doc for r in df.select("k", F.to_json(parse_document(F.col("text"))).alias("doc")).collect()}
    for k, text in enumerate(texts):
        want = DOCS.get(text)
        if text == "s: !!set {a, b}":
            assert sorted(json.loads(out[k])["s"]) == ["a", "b"]
        elif text == "when: 2024-13-45":
            assert out[k] is None or json.loads(out[k]) == want  # the loader may refuse the date
        else:
            assert (out[k] and json.loads(out[k])) == want, text[:60]
