"""Editing sessions: a log of actions folded over a document, and drafts restored.

A session is one person's clicks on one document.  Sessions are independent, so
they are dealt out by document; within one, actions are applied in order, because
an undo takes back the last removal of any list and accepting all that is safe
depends on what was done before.  State is held by field, not by document: a
session costs what it touches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbloom.functions import fields

METHODS = ["scraped", "derived", "ai-live", "ai-mock", "user-edited", "not-found"]
ACTIONS = [
    "set_field", "accept_field", "accept_all_safe", "accept_category", "resolve_conflict", "revert_field", "add_item", "update_item", "remove_item", "undo_remove", "reorder",
    "answer_question", "mark_saved", "restore",
]

STATE = "doc string, draft string, reviewed array<string>, dirty array<string>, removed int, saved boolean, refused array<long>"


def _cleared(value):
    """A blank string and an empty list are no value; strings are trimmed."""
    if isinstance(value, str):
        value = value.strip()
    return None if value == "" or value == [] else value


def _shown(value) -> str:
    return "nothing" if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict | list) else str(value)


class _Session:
    """The state of one session; fields are envelopes by path."""

    def __init__(self, document: dict):
        self.load(document)
        self.reviewed: set[str] = set()
        self.removed: list[tuple[str, int, dict]] = []
        self.saved = False

    def load(self, document: dict) -> None:
        self.rest = document
        self.original = {p: f for p, *_ in fields.FIELDS if isinstance(f := _at(document, p), dict)}
        self.draft, self.dirty = dict(self.original), set()
        self.conflicts = {c["path"]: c for c in (document.get("quality") or {}).get("conflicts") or []}

    def items(self, path: str) -> list:
        value = self.draft[path].get("value")
        return value if isinstance(value, list) else []

    def write(self, path: str, field: dict, dirty: bool) -> None:
        self.draft[path] = field
        (self.dirty.add if dirty else self.dirty.discard)(path)
        self.reviewed.add(path)
        self.saved = False

    def field(self, path: str, value) -> None:
        value = _cleared(value)
        edited = {"value": value, "method": "user-edited", "confidence": 1, "sourceUrls": self.draft[path].get("sourceUrls", [])}
        self.write(path, edited, (self.original.get(path) or {}).get("value") != value)

    def collection(self, path: str, items: list) -> None:
        held = self.draft[path]
        own = {"method": "user-edited", "confidence": 1} if held.get("value") is None else {}
        self.write(path, {**held, "value": items, **own}, ((self.original.get(path) or {}).get("value") or []) != items)

    def attention(self) -> Iterator[str]:
        for path, field in self.draft.items():
            method, value = field.get("method"), field.get("value")
            asks = method in ("ai-live", "ai-mock") or field.get("note") is not None or (value is not None and (field.get("confidence") or 0) < 0.5)
            if path not in self.reviewed and method != "user-edited" and asks:
                yield path

    def act(self, action: str, path: str | None, given) -> bool:
        """Apply one action; False if it does not fit the state, which then stays as it is."""
        if action in ("accept_field", "accept_all_safe", "accept_category"):
            safe = lambda p: self.draft[p].get("method") not in ("ai-live", "ai-mock") and not (p in self.conflicts and not self.conflicts[p].get("resolved"))
            chosen = [path] if action == "accept_field" else [p for p in self.attention() if (safe(p) if action == "accept_all_safe" else fields.category(p) == given)]
            self.reviewed.update(chosen)
        elif action == "mark_saved":
            self.load(self.document() if given is None else given)
            self.removed, self.saved = [], True
        elif action == "restore":
            kept = _Session(given["original"])
            kept.draft = {p: f for p, *_ in fields.FIELDS if isinstance(f := _at(given["draft"], p), dict)}
            kept.conflicts = {c["path"]: c for c in (given["draft"].get("quality") or {}).get("conflicts") or []}
            kept.reviewed, kept.dirty = set(given.get("reviewed") or []), set(given.get("dirty") or [])
            kept.removed, kept.saved = [(r["path"], r["index"], r["record"]) for r in given.get("removed") or []], bool(given.get("saved"))
            self.__dict__ = kept.__dict__
        elif action == "answer_question":
            answers = {p: v for p, v in given.items() if _cleared(v) is not None and p in self.draft}
            for p, v in answers.items():
                self.field(p, v)
            return bool(answers)
        elif action == "undo_remove":
            if not self.removed:
                return False
            path, index, record = self.removed.pop()
            items = self.items(path)
            self.collection(path, [*items[:index], record, *items[index:]])
        elif path not in self.draft:
            return False
        elif action == "set_field":
            self.field(path, given)
        elif action == "revert_field":
            if path not in self.original:
                return False
            self.draft[path], self.saved = self.original[path], False
            self.dirty.discard(path)
            self.reviewed.discard(path)
        elif action == "resolve_conflict":
            return self.resolve(path, given)
        else:
            return self.edit(action, path, given)
        return True

    def resolve(self, path: str, given: dict) -> bool:
        held = self.conflicts.get(path)
        if held is None:
            return False
        others = held.get("candidates") or []
        if "index" in given and not 0 <= given["index"] < len(others):
            return False
        chosen = others[given["index"]]["value"] if "index" in given else given["value"]
        lost = [f"{_shown(c['value'])} ({c.get('sourceLabel') or c.get('sourceUrl')})" for c in others if c["value"] != chosen]
        kept = self.draft[path].get("value") == chosen
        field = {**self.draft[path], "confidence": 1} if kept else {"value": chosen, "method": "user-edited", "confidence": 1, "sourceUrls": self.draft[path].get("sourceUrls", [])}
        field.pop("note", None)
        self.write(path, {**field, "note": f"You chose this over {', '.join(lost)}."} if lost else field, not kept)
        self.conflicts[path] = {**held, "resolved": True}
        return True

    def edit(self, action: str, path: str, given) -> bool:
        items = self.items(path)
        if action == "add_item":
            self.collection(path, [*items, given])
            return True
        if action == "reorder":
            a, b = given["from"], given["to"]
            if a == b or not (0 <= a < len(items) and 0 <= b < len(items)):
                return False
            rest = items[:a] + items[a + 1 :]
            self.collection(path, [*rest[:b], items[a], *rest[b:]])
            return True
        # records without an id are named by their place
        key = lambda k: items[k]["id"] if isinstance(items[k], dict) and isinstance(items[k].get("id"), str) else str(k)
        at = [k for k in range(len(items)) if key(k) == given["id"]]
        if action == "update_item":
            own = {**given["patch"], "method": "user-edited", "confidence": 1}
            self.collection(path, [{**x, **own} if k in at else x for k, x in enumerate(items)])
            return True
        if not at:
            return False
        self.removed.append((path, at[0], items[at[0]]))
        self.collection(path, items[: at[0]] + items[at[0] + 1 :])
        return True

    def document(self) -> dict:
        out = json.loads(json.dumps(self.rest))
        for path, field in self.draft.items():
            head, _, name = path.partition(".")
            if name:
                out.setdefault(head, {})[name] = field
            else:
                out[head] = field
        if self.conflicts:
            out.setdefault("quality", {})["conflicts"] = list(self.conflicts.values())
        return out


def _at(document: dict, path: str):
    for name in path.split("."):
        document = document.get(name) if isinstance(document, dict) else None
    return document


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, document, actions in zip(batch.doc, batch.document, batch.actions, strict=True):
            session, refused = _Session(json.loads(document)), []
            for a in [] if actions is None else actions:
                try:
                    fits = session.act(a["action"], a["path"], None if a["payload"] is None else json.loads(a["payload"]))
                except (ValueError, KeyError, TypeError, AttributeError):
                    fits = False
                if not fits:
                    refused.append(int(a["seq"]))
            rows.append((doc, json.dumps(session.document(), ensure_ascii=False, separators=(",", ":")), sorted(session.reviewed), sorted(session.dirty), len(session.removed), session.saved, refused))
        yield pd.DataFrame(rows, columns=["doc", "draft", "reviewed", "dirty", "removed", "saved", "refused"])


def sessions(documents: DataFrame, log: DataFrame) -> DataFrame:
    """The draft that each document's session ends with.

    ``documents(doc, document)`` are JSON; ``log(doc, seq, action, path, payload)``
    has the fourteen `ACTIONS`, payloads as JSON: a value, a record, a patch with
    an id, places to reorder, a choice (index or value), a category, answers by
    path, the saved document (null: the draft) or a whole state.  ``dirty`` are
    fields whose value isn't the original's, ``removed`` counts removals that can
    be undone, ``refused`` are actions that did not fit and changed nothing.
    Documents without actions come back as they are, with their conflicts and all
    else that is no field; documents that are no JSON object are left out.
    """
    acts = log.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("seq", "action", "path", "payload"))).alias("actions"))
    good = documents.where(F.try_parse_json("document").isNotNull() & F.ltrim("document").startswith("{"))
    return good.select("doc", "document").join(acts, "doc", "left").mapInPandas(_folded, STATE)


def serialized(original: Column, draft: Column, reviewed: Column, dirty: Column, saved: Column) -> Column:
    """A draft as it is kept between visits: JSON text of both documents and the marks."""
    parts = [("original", original), ("draft", draft), ("reviewed", F.to_json(reviewed)), ("dirty", F.to_json(dirty)), ("removed", F.lit("[]")), ("saved", saved.cast("string"))]
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), v) for n, v in parts]), F.lit("}"))


def wrong_field(document: Column) -> Column:
    """The first path whose envelope isn't one, in the order of the field table; null for none."""
    methods = F.array(*map(F.lit, METHODS))
    tests = []
    for path, *_ in fields.FIELDS:
        field = F.get_json_object(document, f"$.{path}")
        method, confidence = F.get_json_object(field, "$.method"), F.get_json_object(field, "$.confidence").try_cast("double")
        good = F.array_contains(methods, method) & confidence.between(0, 1) & F.get_json_object(field, "$.sourceUrls").startswith("[")
        tests.append(F.when(~F.coalesce(good, F.lit(False)), F.lit(path)))
    return F.coalesce(*tests)


def restore(drafts: DataFrame) -> DataFrame:
    """(doc, problem, original, draft, reviewed, dirty, saved) of ``drafts(doc, raw)``.

    A draft whose text is no JSON, or one of whose documents lacks a proper field,
    has a problem and no state: ``no json``, or the document's name and the path.
    """
    part = lambda name: F.get_json_object("raw", f"$.{name}")
    held = drafts.select("doc", "raw", part("original").alias("original"), part("draft").alias("draft"))
    held = held.withColumns({"a": wrong_field(F.col("original")), "b": wrong_field(F.col("draft"))})
    problem = F.when(F.try_parse_json("raw").isNull(), "no json").when(F.col("a").isNotNull(), F.concat(F.lit("original: "), "a")).when(F.col("b").isNotNull(), F.concat(F.lit("draft: "), "b"))
    marks = lambda name: F.coalesce(F.from_json(part(name), "array<string>"), F.array().cast("array<string>"))
    out = held.select("doc", problem.alias("problem"), "original", "draft", marks("reviewed").alias("reviewed"), marks("dirty").alias("dirty"), F.coalesce(part("saved").try_cast("boolean"), F.lit(False)).alias("saved"))
    return out.select("doc", "problem", *[F.when(F.col("problem").isNull(), F.col(c)).alias(c) for c in ("original", "draft", "reviewed", "dirty", "saved")])
