"""Secret scan: planted secrets of the tables, false positives removed, the forest itself, edge rows."""

import re

import numpy as np

from repolens.llm import queries, secret_scan

from ..conftest import SMALL
from .helpers import edge_docs

# junk documents shout their secrets, too
PLANTED = re.compile(r'(?i)AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]+|(?<=token = ")[0-9a-f]+')


def test_planted_secrets(spark):
    folder = SMALL.replace("sf0.001", "sf0.1")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op10_secret_scan(spark, folder).collect()
    assert len(rows) == len(docs)
    got = {(r.doc_id, *map(int, f.split(":"))) for r in rows if r.findings for f in r.findings.split(",")}
    want = {(d, *m.span()) for d, t in docs.items() for m in PLANTED.finditer(t)}
    assert len(want & got) > 0.98 * len(want) and len(got - want) < 0.02 * len(want)
    assert sum(r.n_candidates for r in rows) > 1.5 * len(want)  # there are false positives to remove


def test_forest_learns_on_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = [secret_scan.grow(x[:2000], y[:2000], np.random.default_rng(i)) for i in range(25)]
    assert ((secret_scan.votes(forest, x[2000:]) > 0.5) == y[2000:]).mean() > 0.93


def test_candidates():
    text = 'password=7602ad27cf5550de1c api: "aBcdefghijklmnopq" plainlowercaseword 4111111111111111 x=short'
    assert [text[a:b] for a, b in secret_scan.candidates(text)] == ["7602ad27cf5550de1c", "aBcdefghijklmnopq", "4111111111111111"]


def test_edge_rows(spark):
    docs = edge_docs(spark)
    out = secret_scan.scan(docs).collect()
    assert len(out) == docs.count() and all(r.n_secrets <= r.n_candidates for r in out)
    assert secret_scan.scan(edge_docs(spark, [])).count() == 0


def test_own_labelled_findings(spark):
    docs = spark.createDataFrame([(1, "id ABCdef1234567890xyz", "a"), (2, "id 1234567890123456789", "a")], "doc_id long, text string, source string")
    shared = spark.sparkContext.broadcast(secret_scan.statistics(docs.select(docs.text.cast("binary"))))
    found = secret_scan.described(docs, "text", "source", shared, False).selectExpr("doc_id", "explode(found) f").collect()
    rows = [(list(r.f.x), int(r.doc_id == 1)) for r in found for _ in range(1)]
    many = [([v + i * 1e-9 for v in x], y) for x, y in rows for i in range(20)]
    out = secret_scan.scan(docs, findings=spark.createDataFrame(many, "x array<double>, label int")).collect()
    assert {r.doc_id: r.n_secrets for r in out} == {1: 1, 2: 0}


def test_features_read_the_whole_candidate():
    rng = np.random.default_rng(1)
    table, words = rng.normal(-4, 1, secret_scan.CELLS), {b"path": 0, b"word": 1}
    head, key = "path/word/" * 20, "".join(rng.choice(list("ABCDEFxyz0189"), 40))  # the same first 200 bytes
    plain, mixed = (np.array(secret_scan.features(t, "", 0, 240, table, words)) for t in (head + "path/word/" * 4, head + key))
    entropy, distinct, mean, least, piece, cover = range(5, 11)
    assert len(plain) == secret_scan.N_FEATURES and plain[cover] == 0.8 and abs(mixed[cover] - 160 / 240) < 1e-9
    assert mixed[entropy] > plain[entropy] and mixed[distinct] > plain[distinct]
    steps = [table[a * 256 + b] for a, b in zip((head + key).encode(), (head + key).encode()[1:])]
    assert abs(mixed[mean] - np.mean(steps)) < 1e-9 and mixed[least] == min(steps)
    assert abs(mixed[piece] - min(np.mean(steps[i:i + 32]) for i in range(len(steps) - 31))) < 1e-9


def test_neighbours_are_whole_words_however_long():
    long = "x" * 300
    text = f"first {long} {' ' * 200}= 'KEY' {long}yz second third"
    a = text.index("KEY")
    before, left, right = secret_scan.around(text, a, a + 3)
    assert before == "= '" and left == ["first", long] and right == [long + "yz", "second"]
    assert secret_scan.around("KEY", 0, 3) == ("", [], [])


def test_cover_takes_long_dictionary_words():
    table = np.full(secret_scan.CELLS, -4.0)
    word = "internationalization"
    assert secret_scan.features(word, "", 0, 20, table, {word.encode(): 0})[10] == 1.0
