"""Markdown and DOCX of assembled documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions.text import trim_ws


def blocks(text: Column) -> Column:
    """Paragraphs of a body: its non-blank lines, each followed by an empty line."""
    lines = F.filter(F.transform(F.split(text, "\n"), trim_ws), lambda x: x != "")
    return F.concat(F.array_join(lines, "\n\n"), F.when(F.size(lines) > 0, "\n\n").otherwise(""))


def clause_markdown(number: Column, heading: Column, eff: Column, body: Column) -> Column:
    md = blocks(body)
    level = F.least(eff + 2, F.lit(6))
    bare = F.concat(number, F.lit(" "), md, F.when(md == "", "\n").otherwise(""))
    headed = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), number, F.lit(". "), heading, F.lit("\n\n"), md)
    return F.concat(F.when(trim_ws(heading) == "", bare).otherwise(headed), F.lit("\n"))


def markdown(rows: DataFrame, documents: DataFrame, schedules: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown): title, clause tree in order, schedules, governing law. One ordered aggregation a document."""
    line = clause_markdown(F.col("new_number"), F.col("new_heading"), F.col("eff"), F.col("new_body"))
    parts = rows.select("doc_id", F.struct(F.lit(1).alias("sec"), F.col("pos").cast("long").alias("pos"), line.alias("s")).alias("x"))
    if schedules is not None:
        md = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), blocks(F.col("body")), F.lit("\n"))
        parts = parts.unionByName(schedules.select("doc_id", F.struct(F.lit(2).alias("sec"), F.col("schedule_no").cast("long").alias("pos"), md.alias("s")).alias("x")))
    body = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("body"))
    head = F.concat(F.lit("# "), F.coalesce(F.when(trim_ws(F.coalesce("title", F.lit(""))) != "", F.col("title")), F.col("contract_type"), F.lit("")), F.lit("\n\n"))
    foot = F.coalesce(F.concat(F.lit("\n_Governing law: "), F.col("jurisdiction"), F.lit("._\n")), F.lit(""))
    return body.join(documents.select("doc_id", "title", "contract_type", "jurisdiction"), "doc_id").select("doc_id", F.concat(head, F.col("body"), foot).alias("markdown"))


# --- OOXML, in Python: a zip can't be written by an expression ---------------------------------


def esc(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def paragraph_xml(text: str, style: str | None = None, bold: bool = False) -> str:
    p = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    r = "<w:rPr><w:b/></w:rPr>" if bold else ""
    return f'<w:p>{p}<w:r>{r}<w:t xml:space="preserve">{esc(text)}</w:t></w:r></w:p>'


@dataclass
class Donor:
    """Style parts taken over from an existing DOCX."""

    parts: dict[str, str] = field(default_factory=dict)
    sect_pr: str | None = None
    num_ids: frozenset[str] = frozenset()
    main_num_id: str | None = None

    PARTS = ("word/styles.xml", "word/theme/theme1.xml", "word/fontTable.xml", "word/numbering.xml", "word/settings.xml")

    @classmethod
    def from_docx(cls, data: bytes) -> Donor:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            parts = {p: z.read(p).decode("utf-8", "replace") for p in cls.PARTS if p in names}
            doc = z.read("word/document.xml").decode("utf-8", "replace") if "word/document.xml" in names else ""
        ids = frozenset(re.findall(r'<w:num\s[^>]*?w:numId="([^"]*)"', parts.get("word/numbering.xml", "")))
        sect = re.findall(r"(?s)<w:sectPr.*?</w:sectPr>|<w:sectPr[^>]*/>", doc)
        top = Counter()
        for np in re.findall(r"(?s)<w:numPr.*?</w:numPr>", doc):
            level, num = re.search(r'<w:ilvl w:val="([^"]*)"', np), re.search(r'<w:numId w:val="([^"]*)"', np)
            if num and (level is None or level[1] == "0") and num[1] in ids:
                top[num[1]] += 1
        clean = re.sub(r"<w:(?:header|footer)Reference[^>]*/>", "", sect[-1]) if sect else None
        return cls(parts, clean, ids, max(sorted(top), key=lambda k: top[k]) if top else None)

    @property
    def usable(self) -> bool:
        return "word/styles.xml" in self.parts


def sanitise(p: str, num_ids: Iterable[str] = ()) -> str:
    """A lifted paragraph without undefined lists, drawings and field machinery; links keep their text."""
    num = re.search(r'(?s)<w:numPr.*?<w:numId[^>]*w:val="([^"]*)".*?</w:numPr>', p)
    if num and num[1] not in set(num_ids):
        p = re.sub(r"(?s)<w:numPr\s*/>|<w:numPr\b.*?</w:numPr>", "", p)
    for tag in ("drawing", "pict", "object"):
        p = re.sub(rf"(?s)<w:{tag}\b(?:[^>]*/>|.*?</w:{tag}>)", "", p)
    p = re.sub(r"</?w:fldSimple[^>]*>|</?w:hyperlink[^>]*>", "", p)
    return re.sub(r"(?s)<w:r(?:\s[^>]*)?>(?:(?!</w:r>).)*?<w:(?:fldChar|instrText).*?</w:r>", "", p)


def rewrite_ooxml(p: str, numbers: dict[str, str]) -> str:
    """References rewritten in the text between <w:t> tags only."""
    ref = re.compile(r"(?i)(clauses?\s+)(\d+(?:\.\d+)*)")
    return re.sub(r"(?s)(<w:t[^>]*>)(.*?)(</w:t>)", lambda m: m[1] + ref.sub(lambda r: r[1] + numbers.get(r[2], r[2]), m[2]) + m[3], p)


def lift(lines: list[tuple[str | None, str]], lifted: dict[str, list]) -> list[tuple[str | None, str]]:
    """Lines with the paragraphs of a clause replaced by its source's raw ones (style RAW).

    ``lifted``: first line of a clause to (its body, whether that line is a heading, raw paragraphs). A heading stays
    as a line, numbered anew; of an unheaded clause the first line carries the number and stays too.
    """
    out, i = [], 0
    while i < len(lines):
        out.append(lines[i])
        found = lifted.get(lines[i][1].strip())
        i += 1
        if found is None:
            continue
        body, headed, raw = found
        own = [x.strip() for x in body.split("\n") if x.strip()][0 if headed else 1 :]
        if [t.strip() for _, t in lines[i : i + len(own)]] == own:
            out += [(RAW, x) for x in (raw if headed else raw[1:])]
            i += len(own)
    return out


RAW = "raw paragraph"


def docx_bytes(title: str, lines: list[tuple[str | None, str]], donor: Donor | None = None) -> bytes:
    """A minimal DOCX of (style, text) lines; a donor brings styles, lists and section. Lines of style RAW are XML."""
    body = paragraph_xml(title, "Title") + "".join(t if s == RAW else paragraph_xml(t, s) for s, t in lines) + ((donor.sect_pr or "") if donor else "")
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    kinds = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{p.rpartition("/")[2].removesuffix(".xml")}+xml"/>' for p in (donor.parts if donor else {}))
    files = {
        "[Content_Types].xml": f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>{kinds}</Types>',
        "_rels/.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document {ns}><w:body>{body}</w:body></w:document>',
        **(donor.parts if donor else {}),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def docx(md: DataFrame, donor: Donor | None = None) -> DataFrame:
    """(doc_id, docx): a DOCX file of each document's Markdown, made where the row is."""

    def run(batches):
        for batch in batches:
            files = []
            for text in batch.column(1).to_pylist():
                lines = [x for x in (text or "").split("\n") if x.strip()]
                title = lines[0].lstrip("# ") if lines else ""
                rest = [(f"Heading{min(6, len(x) - len(x.lstrip('#')) - 1)}" if x.startswith("#") else None, x.lstrip("# ")) for x in lines[1:]]
                files.append(docx_bytes(title, rest, donor))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, type=pa.binary())], names=["doc_id", "docx"])

    return md.select("doc_id", "markdown").mapInArrow(run, "doc_id long, docx binary")
