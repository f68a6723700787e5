import json
import random

import pytest
from pyspark.sql import functions as F

from lexmill import cli
from lexmill.operators import numbering, packing


def test_build_and_ask(spark, tmp_path, capsys):
    (tmp_path / "h").mkdir()
    (tmp_path / "m").mkdir()
    text = "A paragraph about meditation that is long enough to stay."
    (tmp_path / "h" / "a.html").write_text(f"<title>One</title><body><p>{text}</p><p>Another paragraph about something else entirely.</p></body>")
    (tmp_path / "m" / "b.md").write_text("# Two\n\nMeditation in Markdown.\n")
    root = str(tmp_path / "corpus")

    def run(*args):
        code = cli.main([root, *args], spark)
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert run("search", "meditation")[0] == 2
    assert {r["source"]: (r["passages"], r["duplicates"]) for r in run("build", "--html", f"en={tmp_path / 'h'}", "--markdown", f"de={tmp_path / 'm'}")[1]} == {"en": (2, 0), "de": (1, 0)}
    assert sorted(r["id"] for r in run("search", "meditation")[1]) == [1, 2]
    assert run("fuzzy", "meditaton")[1][0]["query_hits"] == 1
    assert [r["selected"] for r in run("passage", "en:a.html#p0001")[1]] == [True, False]
    assert run("search", "!!")[0] == 2
    assert run("build")[0] == 2 and len(run("stats")[1]) == 2


def test_own_categories_and_graph(spark, tmp_path, capsys):
    for name, text in (("stories", "A story about a lamp that is long enough to stay."), ("talks", "A talk about a lamp that is long enough to stay."), ("notes", "A note about a lamp that is long enough to stay.")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.html").write_text(f"<title>One</title><body><p>{text}</p></body>")
    (tmp_path / "g" / "relationships").mkdir(parents=True)
    claims = [{"claim_id": f"{s}#1", "document_id": f"{s}:a", "citation": f"{s}:a.html#p0001", "passage_id": "p0001", "statement": "lamps", "quote": "lamp", "odd": 1} for s in ("stories", "talks")]
    (tmp_path / "g" / "claims.json").write_text(json.dumps({"claims": [*claims, {"claim_id": " "}]}))
    linked = {"connections": [{"connection_id": "conn-001", "type": "supports", "claim_ids": ["stories#1", "talks#1"]}], "themes": [{"theme_id": "theme-001", "label": "Lamps", "claim_ids": ["stories#1"]}, {"label": "none"}]}
    (tmp_path / "g" / "relationships" / "result.json").write_text(json.dumps(linked))
    root = str(tmp_path / "corpus")

    def run(*args):
        code = cli.main([root, *args], spark)
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    build = ["build", *(x for s in ("talks", "stories", "notes") for x in ("--html", f"{s}={tmp_path / s}"))]
    assert run(*build)[0] == 0 and run("connections", "--query", "lamp")[0] == 2
    assert run(*build, "--graph", str(tmp_path / "g"))[0] == 0
    assert sorted(r["source"] for r in run("search", "lamp")[1]) == ["stories", "talks"]
    assert sorted(r["source"] for r in run("search", "lamp", "--source", "notes+talks")[1]) == ["notes", "talks"]
    assert run("search", "lamp", "--source", "en")[0] == 2
    assert [r["graph_id"] for r in run("connections", "--query", "lamp")[1]] == ["conn-001", "theme-001"]
    assert [r["graph_id"] for r in run("connections", "--claim-id", "stories#1", "--source", "stories")[1]] == ["theme-001"]
    assert run("connections")[0] == 2 and run("connections", "--claim-id", "zz")[0] == 2
    assert run("graph-stats")[1] == [{"claims": 2, "with_passage": 2, "connections": 1, "themes": 1, "claims_in_graph": 2, "unknown_claims": 0}]


def test_packing(spark):
    rows = [("d1", f"p{i}", "a", i, "x" * 50) for i in range(4)] + [("d2", "p0", "a", 0, "y" * 500)]
    out = packing.document_chunks(spark.createDataFrame(rows, "document_id string, passage_id string, anchor string, ordinal int, text string"), 230)
    assert {(r["document_id"], r["passage_id"]): r["chunk"] for r in out.collect()} == {("d1", "p0"): 1, ("d1", "p1"): 1, ("d1", "p2"): 2, ("d1", "p3"): 2, ("d2", "p0"): 1}
    chunks = spark.createDataFrame([(0, "a", 5), (1, "a", 1), (2, "b", 6), (3, "c", 5), (4, "d", 1)], "position long, document_id string, size long")
    assert [r["batch"] for r in packing.batches(chunks, 8, 2).orderBy("position").collect()] == [1, 2, 2, 3, 3]
    assert [r["batch"] for r in packing.batches(chunks, 8, 2, block=3).orderBy("position").collect()] == [1, 2, 2, 3, 3]


def test_audit_and_upsert(spark):
    act = "remove_ordinary_english"
    found = spark.createDataFrame([(1, 1, act, "r", "high"), (2, 1, act, "r", "high"), (3, 2, "keep", "r", "low"), (4, 9, act, "r", "low"), (5, 2, act, " ", "low"), (6, 2, act, "r", "sure"), (7, 2, act, "r", "low")], "position int, candidate_number int, action string, reason string, confidence string")
    known = spark.createDataFrame([(1,), (2,)], "candidate_number int")
    audited = packing.audit_findings(found, known)
    assert [r["warning"] for r in audited.orderBy("position").collect()] == [None, "repeated candidate", "unknown action", "unknown candidate", "no reason", "unknown confidence", None]
    assert [tuple(r) for r in packing.action_counts(audited).collect()] == [(act, 2)]
    stored = spark.createDataFrame([("a", True, 1), ("b", False, 1)], "id string, pinned boolean, v int")
    fresh = spark.createDataFrame([("a", False, 2), ("c", False, 2)], "id string, pinned boolean, v int")
    assert sorted(tuple(r) for r in packing.upsert(stored, fresh).collect()) == [("a", True, 2), ("b", False, 1), ("c", False, 2)]


@pytest.mark.parametrize("block", [5, 16, 4096])
def test_batches_equal_the_fold(spark, block):
    r = random.Random(block)
    for count, most, names in ((5, 30, 3), (4, 1000, 50), (5, 12, 1000)):
        chunks = [(7 * k, f"d{r.randrange(names)}" if r.random() < 0.9 else None, r.randint(1, 14)) for k in range(300)]
        want, batch, held, inside = [], 1, 0, []
        for _, document, size in chunks:
            if inside and (held + size > most or len(inside) >= count or document in inside):
                batch, held, inside = batch + 1, 0, []
            held += size
            inside.append(document)
            want.append(batch)
        got = packing.batches(spark.createDataFrame(chunks, "position long, document_id string, size int"), most, count, block)
        assert [x["batch"] for x in got.orderBy("position").collect()] == want
    assert packing.batches(spark.createDataFrame([], "position long, document_id string, size int"), 5).count() == 0


def test_numbers_in_an_order(spark):
    """Hashed ids, all but equal groups, nulls: places are those of a sort, and no task reads all rows."""
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.randrange(-(2**62), 2**62)) for _ in range(3000)] + [("hot", None), ("hot", 5), ("hot", 5)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(8)
    key = lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or 0)
    placed = numbering.positions(df, ["g", "k"], "place")
    assert [(x["g"], x["k"]) for x in placed.orderBy("place").collect()] == sorted(rows, key=key)
    assert sorted(x["place"] for x in placed.collect()) == list(range(len(rows)))
    ranks = {(x["g"], x["k"]): x["ordinal"] for x in numbering.ordinals(df, "g", "k").collect()}
    for group in ("hot", "b", None):
        assert [ranks[x] for x in sorted({x for x in rows if x[0] == group}, key=key)] == list(range(len({x for x in rows if x[0] == group})))
    spread = df.repartitionByRange(4, "g", "k").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(spread) == 4 and max(x["count"] for x in spread) < 2000
