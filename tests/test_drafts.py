"""Editing sessions against a naive model on whole documents, and restored drafts."""

import copy
import json
import random

from pyspark.sql import functions as F

from kbloom.functions import fields
from kbloom.operators import drafts

EMPTY = {"value": None, "method": "not-found", "confidence": 0.0, "sourceUrls": []}
LISTS = ["people", "offerings", "foundation.otherLocations"]
SCALARS = ["companyName", "foundation.phone", "foundation.email"]


def put(document, path, field):
    head, _, name = path.partition(".")
    if name:
        document.setdefault(head, {})[name] = field
    else:
        document[head] = field


def get(document, path):
    head, _, name = path.partition(".")
    return document[head][name] if name else document[head]


def document():
    d = {"sourceUrl": "https://a.com/"}
    for p, *_ in fields.FIELDS:
        put(d, p, copy.deepcopy(EMPTY))
    put(d, "companyName", {"value": "Bee", "method": "scraped", "confidence": 0.45, "sourceUrls": ["u"], "note": "We found 2"})
    put(d, "foundation.overview", {"value": "Text", "method": "ai-live", "confidence": 0.9, "sourceUrls": []})
    put(d, "foundation.email", {"value": "a@b.c", "method": "scraped", "confidence": 0.3, "sourceUrls": ["u"]})
    put(d, "people", {"value": [{"id": "p1", "name": "Ann"}, {"id": "p2", "name": "Bob"}, {"id": "p3", "name": "Cy"}], "method": "scraped", "confidence": 0.7, "sourceUrls": ["u"]})
    put(d, "foundation.otherLocations", {"value": [{"formatted": "x"}, {"formatted": "y"}], "method": "scraped", "confidence": 0.7, "sourceUrls": ["u"]})
    d["quality"] = {"overallScore": 0.1, "conflicts": [{"path": "companyName", "candidates": [{"value": "Bee", "sourceLabel": "on the home page"}, {"value": "Wasp", "sourceUrl": "u2"}], "resolved": False}]}
    return d


class Model:
    """Whole documents, copied for every action."""

    def __init__(self, d):
        self.o, self.d, self.rev, self.rem, self.saved = copy.deepcopy(d), copy.deepcopy(d), set(), [], False

    def dirty(self):
        return sorted(p for p, *_ in fields.FIELDS if p in self.touched)

    touched: set

    def mark(self, path):
        a, b = get(self.o, path)["value"], get(self.d, path)["value"]
        if path in LISTS:
            a, b = a or [], b or []
        (self.touched.discard if a == b else self.touched.add)(path)
        self.rev.add(path)
        self.saved = False

    def set(self, path, v):
        v = v.strip() if isinstance(v, str) else v
        put(self.d, path, {"value": None if v in ("", []) else v, "method": "user-edited", "confidence": 1, "sourceUrls": get(self.d, path)["sourceUrls"]})
        self.mark(path)

    def list(self, path, items):
        f = dict(get(self.d, path))
        if f["value"] is None:
            f |= {"method": "user-edited", "confidence": 1}
        put(self.d, path, {**f, "value": items})
        self.mark(path)

    def asks(self):
        for p, *_ in fields.FIELDS:
            f = get(self.d, p)
            if p not in self.rev and f["method"] != "user-edited" and (f["method"].startswith("ai") or "note" in f or (f["value"] is not None and f["confidence"] < 0.5)):
                yield p, f

    def act(self, action, path, g):
        open_ = not self.d["quality"]["conflicts"][0]["resolved"]
        if action == "set_field":
            self.set(path, g)
        elif action == "accept_field":
            self.rev.add(path)
        elif action == "accept_all_safe":
            self.rev |= {p for p, f in list(self.asks()) if not f["method"].startswith("ai") and not (p == "companyName" and open_)}
        elif action == "accept_category":
            self.rev |= {p for p, _ in list(self.asks()) if fields.category(p) == g}
        elif action == "resolve_conflict":
            c = self.d["quality"]["conflicts"][0]
            if path != c["path"] or g.get("index", 0) > 1:
                return False
            v = c["candidates"][g["index"]]["value"] if "index" in g else g["value"]
            f = get(self.d, path)
            same = f["value"] == v
            new = {k: x for k, x in f.items() if k != "note"} | {"confidence": 1} if same else {"value": v, "method": "user-edited", "confidence": 1, "sourceUrls": f["sourceUrls"]}
            lost = [f"{x['value']} ({x.get('sourceLabel') or x.get('sourceUrl')})" for x in c["candidates"] if x["value"] != v]
            if lost:
                new["note"] = f"You chose this over {', '.join(lost)}."
            put(self.d, path, new)
            c["resolved"] = True
            self.rev.add(path)
            self.saved = False
            (self.touched.discard if same else self.touched.add)(path)
        elif action == "revert_field":
            put(self.d, path, copy.deepcopy(get(self.o, path)))
            self.rev.discard(path)
            self.touched.discard(path)
            self.saved = False
        elif action == "undo_remove":
            if not self.rem:
                return False
            path, k, x = self.rem.pop()
            items = list(get(self.d, path)["value"] or [])
            items.insert(min(k, len(items)), x)
            self.list(path, items)
        elif action == "answer_question":
            some = {p: v for p, v in g.items() if (v.strip() if isinstance(v, str) else v) not in ("", [], None)}
            for p, v in some.items():
                self.set(p, v)
            return bool(some)
        elif action == "mark_saved":
            self.o, self.touched, self.rem, self.saved = copy.deepcopy(self.d), set(), [], True
        else:
            items = list(get(self.d, path)["value"] or []) if isinstance(get(self.d, path)["value"], list) else []
            if action == "add_item":
                return self.list(path, [*items, g])
            if action == "reorder":
                if g["from"] == g["to"] or not all(0 <= g[x] < len(items) for x in ("from", "to")):
                    return False
                items.insert(g["to"], items.pop(g["from"]))
                return self.list(path, items)
            hit = [k for k, x in enumerate(items) if x.get("id", str(k)) == g["id"]]
            if action == "update_item":
                return self.list(path, [{**x, **g["patch"], "method": "user-edited", "confidence": 1} if k in hit else x for k, x in enumerate(items)])
            if not hit:
                return False
            self.rem.append((path, hit[0], items.pop(hit[0])))
            self.list(path, items)


def random_action(r):
    kind = r.choice([a for a in drafts.ACTIONS if a != "restore"])
    path = r.choice(LISTS if kind in ("add_item", "update_item", "remove_item", "reorder") else SCALARS + LISTS[:1])
    given = {
        "set_field": lambda: r.choice(["Bee", " new ", "", "x"]) if path not in LISTS else r.choice([[], [{"id": "p1", "name": "Ann"}]]),
        "accept_category": lambda: r.choice(["foundation", "people"]), "resolve_conflict": lambda: r.choice([{"index": 0}, {"index": 1}, {"index": 7}, {"value": "Own"}]),
        "add_item": lambda: {"id": f"n{r.randint(0, 5)}", "name": "N"}, "update_item": lambda: {"id": r.choice(["p1", "p2", "0", "zz"]), "patch": {"name": r.choice("AB")}},
        "remove_item": lambda: {"id": r.choice(["p1", "p2", "p3", "n1", "0", "1", "zz"])}, "reorder": lambda: {"from": r.randint(-1, 3), "to": r.randint(0, 3)},
        "answer_question": lambda: r.choice([{"foundation.phone": "5", "foundation.email": " "}, {"foundation.email": ""}]),
    }.get(kind, lambda: None)()
    return kind, path, given


def test_random_sessions_equal_a_naive_model(spark):
    r, log, want = random.Random(11), [], {}
    for doc in range(60):
        model, refused = Model(document()), []
        model.touched = set()
        for seq in range(r.randint(0, 30)):
            action, path, given = random_action(r)
            log.append((str(doc), seq, action, path, None if given is None else json.dumps(given)))
            if model.act(action, path, copy.deepcopy(given)) is False:
                refused.append(seq)
        want[str(doc)] = (model.d, sorted(model.rev), model.dirty(), len(model.rem), model.saved, refused)
    documents = spark.createDataFrame([(d, json.dumps(document())) for d in want] + [("bad", "[1]")], "doc string, document string")
    got = drafts.sessions(documents, spark.createDataFrame(log, "doc string, seq long, action string, path string, payload string").repartition(3))
    for x in got.collect():
        d, *rest = want.pop(x.doc)
        assert (x.reviewed, sorted(x.dirty), x.removed, x.saved, x.refused) == tuple(rest), x.doc
        assert json.loads(x.draft) == d
    assert not want


def test_undo_is_the_inverse_of_removal(spark):
    """As many undos as removals, across lists, give the document back, in any order of removals."""
    log, k = [], 0
    for path, id_ in (("people", "p2"), ("foundation.otherLocations", "0"), ("people", "p1"), ("foundation.otherLocations", "0"), ("people", "p3")):
        log.append(("a", k, "remove_item", path, json.dumps({"id": id_})))
        k += 1
    log += [("a", k + j, "undo_remove", None, None) for j in range(6)]
    docs = spark.createDataFrame([("a", json.dumps(document()))], "doc string, document string")
    (got,) = drafts.sessions(docs, spark.createDataFrame(log, "doc string, seq long, action string, path string, payload string")).collect()
    assert json.loads(got.draft) == document() and got.dirty == [] and got.refused == [10]


def test_drafts_are_kept_and_corrupt_ones_refused(spark):
    d = document()
    lost = copy.deepcopy(d)
    del lost["foundation"]["phone"]
    odd = copy.deepcopy(d)
    odd["people"]["method"] = "guessed"
    whole = lambda a, b: json.dumps({"original": a, "draft": b, "reviewed": ["people"], "dirty": [], "saved": True})
    rows = [("good", whole(d, d)), ("lost", whole(d, lost)), ("odd", whole(odd, d)), ("cut", whole(d, d)[:-9]), ("null", None)]
    got = {r.doc: r for r in drafts.restore(spark.createDataFrame(rows, "doc string, raw string")).collect()}
    assert {k: r.problem for k, r in got.items()} == {"good": None, "lost": "draft: foundation.phone", "odd": "original: people", "cut": "no json", "null": "no json"}
    assert got["good"].reviewed == ["people"] and got["good"].saved and json.loads(got["good"].draft) == d and got["lost"].draft is None
    # a session's state, kept and restored, goes on where it was
    docs = spark.createDataFrame([("a", json.dumps(d))], "doc string, document string")
    log = spark.createDataFrame([("a", 0, "set_field", "foundation.phone", '"5"'), ("a", 1, "restore", None, whole(d, d)), ("a", 2, "add_item", "people", '{"id": "n"}')], "doc string, seq long, action string, path string, payload string")
    state = drafts.sessions(docs, log)
    (x,) = state.collect()
    assert x.dirty == ["people"] and x.reviewed == ["people"] and json.loads(x.draft)["foundation"]["phone"] == EMPTY
    raw = state.join(docs, "doc").select("doc", drafts.serialized(F.col("document"), F.col("draft"), F.col("reviewed"), F.col("dirty"), F.col("saved")).alias("raw"))
    (back,) = drafts.restore(raw).collect()
    assert back.problem is None and back.dirty == ["people"] and json.loads(back.draft) == json.loads(x.draft)
