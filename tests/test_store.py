"""The store under interleaved writers and readers, removals, rebuilds and damage."""

import glob
import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from kbloom.operators import store


@pytest.fixture
def held(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "kb"))


def rows(spark, *items):
    made = [(org, doc, f"2024-01-{day:02d}", json.dumps(body) if isinstance(body, dict) else body) for org, doc, day, body in items]
    return spark.createDataFrame(made, "org string, doc string, saved_at string, document string").withColumn("saved_at", F.col("saved_at").cast("timestamp_ntz"))


def people(*names):
    return {"people": {"value": [{"name": n} for n in names]}}


def numbers(held):
    return sorted((r.doc, r.version, r.document) for r in held.versions().collect())


def test_interleaved_savers_get_one_and_two(spark, held):
    """Both read the same head; the second to publish is numbered anew, a lost attempt is never seen."""
    first, second, lost, other = (held.prepare(rows(spark, ("o", doc, 1, {"by": by}))) for doc, by in (("a", 1), ("a", 2), ("a", 3), ("b", 4)))
    assert held.versions().count() == 0 and held.head() == 0
    assert second.publish() == 1 and other.publish() == 2 and first.publish() == 3
    assert numbers(held) == [("a", 1, '{"by": 2}'), ("a", 2, '{"by": 1}'), ("b", 1, '{"by": 4}')]
    assert lost.seen == 0 and held.problems().collect() == []
    assert {r.doc: r.version for r in held.current().collect()} == {"a": 2, "b": 1}


def test_random_interleavings_follow_the_order_of_publishing(spark, held):
    r = random.Random(5)
    waiting, want, k = [], {}, 0
    for _ in range(14):
        if waiting and r.random() < 0.55:
            doc, body, one = waiting.pop(r.randrange(len(waiting)))
            one.publish()
            want.setdefault(doc, []).append(body)
        else:
            doc, k = r.choice("ab"), k + 1
            waiting.append((doc, f'{{"k": {k}}}', held.prepare(rows(spark, ("o", doc, 1, {"k": k})))))
    assert numbers(held) == sorted((d, n + 1, b) for d, bodies in want.items() for n, b in enumerate(bodies))
    assert held.problems().collect() == []


def test_several_saves_and_refused_rows(spark, held):
    assert held.save(rows(spark, ("o", "a", 2, {"n": 2}), ("o", "a", 1, {"n": 1}), ("o", None, 1, {}), ("o", "b", 1, "no"), ("o", "c", 1, "[1]"), (None, "a", 1, {"n": 0}))) == 1
    assert held.save(rows(spark, ("o", "x", 1, "no"))) == 1
    held.save(rows(spark, ("o", "a", 1, {"n": 3}), (None, "a", 1, {"n": 4})))
    got = sorted(((r.org or ""), r.doc, r.version, json.loads(r.document)["n"]) for r in held.versions().collect())
    assert got == [("", "a", 1, 0), ("", "a", 2, 4), ("o", "a", 1, 1), ("o", "a", 2, 2), ("o", "a", 3, 3)]
    assert held.problems().collect() == []


def test_removal_cascades_and_says_what_existed(spark, held):
    held.save(rows(spark, ("o", "a", 1, people("A", "B")), ("o", "b", 1, people("C")), ("p", "a", 1, people("D"))))
    held.rebuild()
    held.save(rows(spark, ("o", "a", 2, people("E"))))
    before = held.tables()
    gone = held.remove(spark.createDataFrame([("o", "a"), ("o", "zz"), ("o", None)], "org string, doc string"))
    assert {(r.doc, r.existed) for r in gone.collect()} == {("a", True), ("zz", False)}
    assert sorted((r.org, r.doc) for r in held.versions().collect()) == [("o", "b"), ("p", "a")]
    for tables in (before, held.tables()):
        assert sorted(r.name for r in tables.read("people").collect()) == ["C", "D"]
    again = held.remove(spark.createDataFrame([("o", "a")], "org string, doc string"))
    assert [r.existed for r in again.collect()] == [False]
    # a document that comes back starts anew
    held.save(rows(spark, ("o", "a", 3, people("F"))))
    assert {(r.org, r.doc): r.version for r in held.current().collect()} == {("o", "a"): 1, ("o", "b"): 1, ("p", "a"): 1}
    assert sorted(r.name for r in held.tables().read("people").collect()) == ["C", "D", "F"] and held.problems().collect() == []
    want = numbers(held)
    held.compact()
    held.vacuum()
    assert numbers(held) == want and held.log().where("kind = 'remove'").count() == 0 and held.problems().collect() == []
    held.save(rows(spark, ("o", "a", 4, people("G"))))
    assert {(r.org, r.doc): r.version for r in held.current().collect()}["o", "a"] == 2 and held.problems().collect() == []
    held.rebuild()
    held.vacuum()
    assert sorted(r.name for r in held.tables().read("people").collect()) == ["C", "D", "F", "G"]


def test_a_removal_between_prepare_and_publish(spark, held):
    held.save(rows(spark, ("o", "a", 1, {"n": 1})))
    late = held.prepare(rows(spark, ("o", "a", 2, {"n": 2})))
    held.remove(spark.createDataFrame([("o", "a")], "org string, doc string"))
    late.publish()
    assert numbers(held) == [("a", 1, '{"n": 2}')] and held.problems().collect() == []


def test_a_reader_during_a_rebuild_sees_one_generation(spark, held, monkeypatch):
    held.save(rows(spark, ("o", "a", 1, {**people("A"), "proof": {"awards": {"value": [{"name": "X"}]}}})))
    held.rebuild()
    reader, seen = held.tables(), []
    held.save(rows(spark, ("o", "a", 2, {**people("B"), "proof": {"awards": {"value": [{"name": "Y"}]}}})))
    real = held.generations.publish

    def publish(hidden, number):
        # all tables are written and none is visible
        seen.append((held.tables().generation, {t: held.tables().stored(t).count() for t in ("people", "awards")}))
        return real(hidden, number)

    monkeypatch.setattr(held.generations, "publish", publish)
    counts = held.rebuild()
    assert seen == [(1, {"people": 1, "awards": 1})] and counts["people"] == (1, 2) and held.tables().generation == 2
    for tables in (reader, held.tables()):
        assert sorted(r.name for r in tables.read("people").collect()) == ["A", "B"] and sorted(r.name for r in tables.read("awards").collect()) == ["X", "Y"]
    assert held.rebuild()["awards"] == (2, 2)


def test_damage_is_reported(spark, held):
    for day in (1, 2, 3, 4):
        held.save(rows(spark, ("o", "a", day, {"n": day}), ("o", f"b{day}", day, {})))
    assert held.problems().collect() == []

    def rewritten(commit, change, keep):
        folder = held.commits.folder(commit)
        new = change(spark.read.parquet(folder)).toArrow()
        back = spark.createDataFrame(new)
        copy = folder + "-old"
        shutil.copytree(folder, copy)
        back.write.mode("overwrite").parquet(folder)
        found = {(r.doc, r.version, r.problem) for r in held.problems().collect()}
        shutil.rmtree(folder)
        os.rename(copy, folder)
        assert found == keep

    edit = lambda d: d.withColumn("document", F.when(F.col("doc") == "a", '{"n": 9}').otherwise(F.col("document")))
    rewritten(2, edit, {("a", 2, "edited")})
    # the checksum made to fit: the link and the next version's link don't
    rewritten(2, lambda d: edit(d).withColumn("content", store.content()), {("a", 2, "edited"), ("a", 3, "edited")})
    rewritten(2, lambda d: d.where("doc <> 'a'"), {("a", 2, "missing"), (None, 2, "short")})
    shutil.rmtree(held.commits.folder(3))
    assert {(r.doc, r.version, r.problem) for r in held.problems().collect()} == {("a", 3, "missing"), (None, 3, "short")}


def test_an_unreadable_log_is_no_empty_one(spark, held):
    held.save(rows(spark, ("o", "a", 1, {})))
    for file in glob.glob(f"{held.commits.folder(1)}/*.parquet"):
        with open(file, "wb") as out:
            out.write(b"broken")
    with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
        held.save(rows(spark, ("o", "a", 2, {})))
