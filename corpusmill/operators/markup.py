"""Visible text of trial transcripts in XML. Mixed content keeps its order, which needs a tree: an Arrow function."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import pystr
from corpusmill.functions.arrow import arrow_map

# Elements that hold no text of the transcript.
METADATA = frozenset({"interp", "join", "xptr", "ptr", "ref", "link"})


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def visible_text(e: ET.Element) -> str:
    """Text of an element and all below it, however deep; metadata elements are left out, what follows them is not."""
    out: list[str] = []
    todo: list[tuple[ET.Element, bool]] = [(e, False)]  # an element, and whether it is what follows it that is next
    while todo:
        x, behind = todo.pop()
        if behind:
            out.append(x.tail or "")
            continue
        out.append(x.text or "")
        for child in reversed(x):
            todo.append((child, True))
            if _name(child) not in METADATA:
                todo.append((child, False))
    return "".join(out)


def paragraphs(root: ET.Element, trials_only: bool = True) -> list[str]:
    """Paragraphs of the first body, or of the root; with ``trials_only`` those of trial accounts. A nested one comes again."""
    body = next((e for e in root.iter() if _name(e) == "body"), root)
    places = [e for e in body.iter() if _name(e) == "div1" and e.get("type") == "trialAccount"] if trials_only else [body]
    return [visible_text(p) for e in places for p in e.iter() if _name(p) == "p"]


def tidy(text: Column) -> Column:
    """White space collapsed, none before closing marks nor inside brackets."""
    s = pystr.squeeze(text)
    s = F.regexp_replace(s, r" ([,.;:!?])", "$1")
    return F.regexp_replace(F.regexp_replace(s, r"([(\[{]) ", "$1"), r" ([)\]}])", "$1")


def extract_markup(files: DataFrame, trials_only: bool = True) -> DataFrame:
    """``path``, ``text``, ``error`` of ``path``, ``content`` (BINARY): one line for each paragraph.

    Part-of-speech variants are left out before their content is read. Malformed files have a null text and the error.
    """

    def run(batches):
        for b in batches:
            found, errors = [], []
            for data in b.column("content").to_pylist():
                try:
                    found.append(paragraphs(ET.fromstring(data or b""), trials_only))
                    errors.append(None)
                except ET.ParseError as e:
                    found.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(found, pa.list_(pa.string())), pa.array(errors, pa.string())], ["path", "paragraphs", "error"])

    own = files.where(~F.element_at(F.split("path", "/"), -1).startswith("OBC2POS")).select("path", "content")
    parsed = arrow_map(own, run, "path string, paragraphs array<string>, error string")
    clean = F.filter(F.transform("paragraphs", tidy), lambda s: s != "")
    return parsed.select("path", F.when(F.col("error").isNull(), F.concat(F.array_join(clean, "\n"), F.lit("\n"))).alias("text"), "error")


def output_name(name: Column, ending: str, new: str) -> Column:
    """A file name with its ending replaced."""
    return F.regexp_replace(name, re.escape(ending) + "$", new)
