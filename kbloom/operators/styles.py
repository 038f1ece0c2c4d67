"""Fonts of style sheets, with custom properties resolved."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Families that are no brand's.
GENERIC = frozenset(
    """inherit|initial|unset|revert|serif|sans-serif|monospace|cursive|fantasy|system-ui|ui-serif|ui-sans-serif|ui-monospace|ui-rounded|-apple-system|blinkmacsystemfont|
    segoe ui|helvetica|helvetica neue|arial|roboto|noto sans|liberation sans|apple color emoji|segoe ui emoji|segoe ui symbol|noto color emoji|sans|tahoma|verdana|geneva|times|
    times new roman|georgia|courier|courier new|monaco|consolas|menlo|emoji|math|fangsong""".replace("\n", "").replace("    ", "").split("|")
)
DEPTH = 5
MOST = 6
_USE = re.compile(r"var\(\s*(--[\w-]+)\s*(?:,\s*([^()]*(?:\([^()]*\)[^()]*)*))?\)")


def properties(css: str) -> dict[str, str]:
    """Custom properties of a style sheet; the first declaration counts."""
    out: dict[str, str] = {}
    for name, value in re.findall(r"(--[\w-]+)\s*:\s*([^;{}]+)", css):
        if value.strip():
            out.setdefault(name, value.strip())
    return out


def resolve(value: str, known: dict[str, str]) -> str | None:
    """A value with its var() uses filled in; None if one can't be."""
    for _ in range(DEPTH + 1):
        if "var(" not in value:
            return value
        lost = False

        def fill(m: re.Match) -> str:
            nonlocal lost
            found = known.get(m[1]) or (m[2] or "").strip()
            lost = lost or not found
            return found

        value = _USE.sub(fill, value)
        if lost:
            return None
    return None


def fonts_of(css: str) -> list[str]:
    known, counts = properties(css), {}
    for declared in re.findall(r"font-family\s*:\s*([^;{}]+)", css, re.I):
        for part in (resolve(declared, known) or "").split(","):
            family = re.sub(r"\s+", " ", part.strip().strip("\"'"))
            if family and len(family) <= 40 and not family.startswith("--") and family.lower() not in GENERIC and re.search("[A-Za-z]", family):
                counts[family] = counts.get(family, 0) + 1
    return sorted(counts, key=lambda f: -counts[f])[:MOST]


def _fonts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(i, k, f) for i, css in zip(batch.page_id, batch.css, strict=True) for k, f in enumerate(fonts_of(css or ""))]
        yield pd.DataFrame(rows, columns=["page_id", "place", "family"])


def fonts(sheets: DataFrame) -> DataFrame:
    """Up to six families of ``sheets(page_id, css)``, the most used first."""
    return sheets.select("page_id", "css").mapInPandas(_fonts, "page_id long, place int, family string")
