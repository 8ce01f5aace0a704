"""Prompts, and the checks of what a model gives back. Adapters are injected; nothing here calls a network."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions.text import trim_ws

GUARD = "You are a drafting assistant. Use only what is given; never invent parties, amounts or law."
BLOCK_SCHEMA = 'Answer with a JSON array of blocks, such as [{"type": "paragraph", "runs": [{"text": "..."}]}].'


@dataclass
class Request:
    messages: list[dict]
    max_tokens: int
    json: bool = False


@dataclass
class Response:
    text: str
    tokens_in: int = 0
    tokens_out: int = 0


class Adapter(Protocol):
    """A language model: its id and how it completes a request."""

    id: str

    def complete(self, request: Request) -> Response: ...


@dataclass
class Echo:
    """An adapter without a model, for tests: gives back what it is told."""

    answer: str = "[]"
    id: str = "echo"
    seen: list[Request] = field(default_factory=list)

    def complete(self, request: Request) -> Response:
        self.seen.append(request)
        return Response(self.answer, sum(len(m["content"]) for m in request.messages) // 4, len(self.answer) // 4)


def api_key(adapter: str) -> str | None:
    """A key from the environment only."""
    return os.environ.get(f"{adapter.upper().replace('-', '_')}_API_KEY")


def extract_line(n: Column, term: Column, heading: Column, source: Column, file: Column, body: Column) -> Column:
    """One numbered extract of a prompt."""
    title = F.coalesce(term, heading, F.lit("(untitled)"))
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), title, F.lit(" — source: "), source, F.lit(" / "), file, F.lit("\n"), trim_ws(F.coalesce(body, F.lit(""))), F.lit("\n\n"))


def extracts(hits: DataFrame) -> DataFrame:
    """(query_id, context): the hits of each query as numbered extracts, in order of ``place``."""
    line = extract_line(F.col("place"), F.col("term"), F.col("heading"), F.col("source"), F.col("rel_path"), F.col("body"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("s")))), lambda x: x["s"]), "").alias("context"))


def ask(question: str, context: str) -> Request:
    system = f"{GUARD}\n\nAnswer from the numbered extracts alone and cite them as [n]; if they don't answer, say so.\n\nExtracts:\n{context}"
    return Request([{"role": "system", "content": system}, {"role": "user", "content": question}], 2048)


def adapt(heading: str, body: str, instructions: str, parties: list[dict], terms: list[str]) -> Request:
    lines = ["Parties:", *(f"- {p['role']} = \"{p['name']}\"" for p in parties)] if parties else []
    if terms:
        lines.append(f"Defined terms to keep: {', '.join(terms)}")
    user = "\n".join(["Adapt this clause.", f"Instructions: {instructions}", *lines, f"Heading: {heading}", "Body:", body, BLOCK_SCHEMA])
    return Request([{"role": "system", "content": GUARD}, {"role": "user", "content": user}], 4096, True)


def explain(heading: str, body: str) -> Request:
    return Request([{"role": "system", "content": GUARD}, {"role": "user", "content": f"Explain in plain words what this clause does, whom it protects and what to watch for.\n\nHeading: {heading}\nBody:\n{body}"}], 1024)


def parse_blocks(raw: str) -> list[dict]:
    """Blocks from a model's answer, bare, wrapped or fenced; anything else is refused."""
    text = raw.strip()
    if text.startswith("```"):
        text = text.removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    try:
        data = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"not blocks: {e}") from None
    rows = data.get("body") if isinstance(data, dict) else data
    if not isinstance(rows, list) or not rows:
        raise ValueError("no blocks")
    for b in rows:
        _check(b)
    return rows


def _check(b) -> None:
    kind = b.get("type") if isinstance(b, dict) else None
    if kind == "paragraph":
        if not any(str(r.get("text", "")).strip() for r in b.get("runs", [])):
            raise ValueError("a paragraph without text")
    elif kind == "variable":
        if not str(b.get("name", "")).strip():
            raise ValueError("a variable without a name")
    elif kind in ("list", "table"):
        for row in b["items" if kind == "list" else "rows"]:
            for cell in row:
                for inner in cell if isinstance(cell, list) else [cell]:
                    _check(inner)
    else:
        raise ValueError(f"an unknown block: {kind}")


def plain_text(b: dict) -> str:
    """A block's text; lists and tables joined by blanks, an empty variable as its label in brackets."""
    if b["type"] == "paragraph":
        return "".join(r.get("text", "") for r in b["runs"])
    if b["type"] == "variable":
        return b.get("value") or f"[{b.get('label', b['name'])}]"
    cells = [c for row in b["items" if b["type"] == "list" else "rows"] for c in row]
    return " ".join(plain_text(x) for c in cells for x in (c if isinstance(c, list) else [c]))
