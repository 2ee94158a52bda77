"""Report content as small DataFrames, and writers for documents and slides.

Content is computed by Spark over groups; only the bounded rows of a report reach a writer.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

TERMS, EXAMPLES, EXAMPLE_CHARS, BARS = 4, 3, 240, 10


def summary_sections(groups: DataFrame) -> DataFrame:
    """Groups by (count descending, label) with percent (1 place) and the first four terms."""
    place = F.row_number().over(Window.orderBy(F.desc("count"), "label"))  # one row per group
    whole = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return groups.select(place.alias("place"), "*", F.bround(F.col("count") / whole * 100, 1).alias("percent"), F.array_join(F.slice("terms", 1, TERMS), ", ").alias("top_terms"))


def representatives(examples: DataFrame, most: int = EXAMPLES, chars: int = EXAMPLE_CHARS) -> DataFrame:
    """The first examples of each group, shortened."""
    return examples.where(F.col("rank") <= most).withColumn("text", X.shortened(F.col("text"), chars))


def chart_bars(counts: DataFrame, name: str, most: int = BARS) -> DataFrame:
    """A27, O05."""
    return counts.select(name, "n").orderBy(F.desc("n"), name).limit(most)


def top_theme(groups: DataFrame) -> DataFrame:
    """The largest group that isn't noise."""
    return groups.where(F.col("community") != -1).orderBy(F.desc("count"), "community").limit(1)


def top_phrase(items: DataFrame) -> DataFrame:
    """The n-gram in most documents."""
    return items.orderBy(F.desc("documents"), F.desc("n"), "term").limit(1)


@dataclass
class Report:
    title: str
    subtitle: str = ""
    summary: list[str] = field(default_factory=list)
    sections: list[tuple[str, list[str]]] = field(default_factory=list)


def filters_text(filters: dict[str, Sequence[str]] | None) -> str:
    """X30."""
    return "; ".join(f"{k}: {', '.join(v)}" for k, v in (filters or {}).items() if v) or "No filters"


def build(groups: DataFrame, examples: DataFrame, title: str, filters: dict[str, Sequence[str]] | None = None, group: str = "community") -> Report:
    """Summary lines and representative sections of already filtered groups (tens of rows)."""
    sections = summary_sections(groups).orderBy("place").collect()
    shown: dict = {}
    for r in representatives(examples).orderBy(group, "rank").collect():
        shown.setdefault(r[group], []).append(r["text"])
    lines = [f"{r['label']}: {r['count']} responses ({r['percent']}%). Terms: {r['top_terms']}" for r in sections]
    return Report(title, filters_text(filters), lines, [(r["label"], shown.get(r[group], [])) for r in sections])


_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{}</Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(report: Report) -> bytes:
    """A text document with headings and bullet paragraphs."""

    def paragraph(text: str, style: str = "") -> str:
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{mark}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = [paragraph(report.title, "Title"), paragraph(report.subtitle), paragraph("Summary", "Heading1"), *map(paragraph, report.summary)]
    for name, texts in report.sections:
        body += [paragraph(name, "Heading2"), *(paragraph(f"• {t}") for t in texts)]
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    return _package(
        {
            "[Content_Types].xml": _TYPES.format(f'<Override PartName="/word/document.xml" ContentType="{main}"/>'),
            "_rels/.rels": _RELS.format(f'<Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/>'),
            "word/document.xml": f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(body)}</w:body></w:document>',
        }
    )


def slides(report: Report, groups_each: int = 4, groups_most: int = 8, sections_each: int = 2) -> list[tuple[str, list[str]]]:
    """S10's pages: a title, summaries of four groups each (eight at most), then two representative sections each."""
    pages = [(report.title, [report.subtitle])]
    lines = report.summary[:groups_most]
    pages += [("Summary", lines[i : i + groups_each]) for i in range(0, len(lines), groups_each)]
    for i in range(0, len(report.sections), sections_each):
        part = report.sections[i : i + sections_each]
        pages.append(("Representative responses", [t for name, texts in part for t in (name, *(f"• {x}" for x in texts))]))
    return pages


def pdf(report: Report, lines_each: int = 48, width: int = 95) -> bytes:
    """Plain pages of text in a standard font."""
    text: list[str] = []
    for title, lines in slides(report, 1 << 30, 1 << 30, 1 << 30):
        for line in (title, *lines, ""):
            text += [line[i : i + width] for i in range(0, max(1, len(line)), width)]
    pages = [text[i : i + lines_each] for i in range(0, len(text), lines_each)]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for page in pages:
        shown = " T* ".join("({}) Tj".format(x.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")) for x in page)
        stream = f"BT /F1 10 Tf 14 TL 50 790 Td {shown} ET"
        objects.append(f"<< /Length {len(stream.encode('cp1252', 'replace'))} >>\nstream\n{stream}\nendstream")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents {len(objects)} 0 R /Resources << /Font << /F1 3 0 R >> >> >>")
        kids.append(f"{len(objects)} 0 R")
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(kids)}] >>"
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n{o}\nendobj\n".encode("cp1252", "replace")
    table = len(out)
    out += f"xref\n0 {len(places) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer << /Size {len(places) + 1} /Root 1 0 R >>\nstartxref\n{table}\n%%EOF".encode())


def ngram_report(items: DataFrame, documents: DataFrame, title: str, filters: dict[str, Sequence[str]] | None = None) -> Report:
    """For each size the first of the five leading terms that has documents, with three of them."""
    rows = items.orderBy("ngram_size", F.desc("n"), "term").collect()  # a few dozen
    lines = [f"{r['term']}: {r['n']} times in {r['documents']} responses" for r in rows]
    sections = []
    for n in (1, 2, 3):
        lead = [r["term"] for r in rows if r["ngram_size"] == n][:5]
        for term in lead:
            texts = [r["text"] for r in documents.where((F.col("ngram_size") == n) & (F.col("term") == term)).orderBy("row_number").limit(EXAMPLES).select(X.shortened(F.col("text"), EXAMPLE_CHARS).alias("text")).collect()]
            if texts:
                sections.append((term, texts))
                break
    return Report(title, filters_text(filters), lines, sections)


_P = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_TREE = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
_MAP = '<p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"/>'


def _theme() -> str:
    colours = "".join(f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in zip(("dk1", "lt1", "dk2", "lt2", *(f"accent{i}" for i in range(1, 7)), "hlink", "folHlink"), ("000000", "FFFFFF", "333333", "EEEEEE", *["4472C4"] * 6, "0563C1", "954F72")))
    font = '<a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/>'
    fill, line = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>' * 3, '<a:ln><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>' * 3
    effect = "<a:effectStyle><a:effectLst/></a:effectStyle>" * 3
    return f'<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" name="Plain"><a:themeElements><a:clrScheme name="Plain">{colours}</a:clrScheme><a:fontScheme name="Plain"><a:majorFont>{font}</a:majorFont><a:minorFont>{font}</a:minorFont></a:fontScheme><a:fmtScheme name="Plain"><a:fillStyleLst>{fill}</a:fillStyleLst><a:lnStyleLst>{line}</a:lnStyleLst><a:effectStyleLst>{effect}</a:effectStyleLst><a:bgFillStyleLst>{fill}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>'


def _box(number: int, y: int, height: int, size: int, lines: Sequence[str]) -> str:
    text = "".join(f'<a:p><a:r><a:rPr lang="en" sz="{size}"/><a:t>{escape(x)}</a:t></a:r></a:p>' for x in lines or [""])
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name="Text {number}"/><p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="457200" y="{y}"/><a:ext cx="8229600" cy="{height}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr wrap="square"/><a:lstStyle/>{text}</p:txBody></p:sp>'


def pptx(report: Report) -> bytes:
    """Slides of a heading and lines of text."""
    pages = slides(report)
    kind = "application/vnd.openxmlformats-officedocument.presentationml."
    rel = lambda i, what, target: f'<Relationship Id="rId{i}" Type="{_OFFICE}/{what}" Target="{target}"/>'
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    names = [f"ppt/slides/slide{i}.xml" for i in range(1, len(pages) + 1)]
    types = {"ppt/presentation.xml": "presentation.main+xml", "ppt/slideMasters/slideMaster1.xml": "slideMaster+xml", "ppt/slideLayouts/slideLayout1.xml": "slideLayout+xml", **dict.fromkeys(names, "slide+xml")}
    overrides = "".join(f'<Override PartName="/{n}" ContentType="{kind}{t}"/>' for n, t in types.items()) + '<Override PartName="/ppt/theme/theme1.xml" ContentType="application/vnd.openxmlformats-officedocument.theme+xml"/>'
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i + 1}"/>' for i in range(1, len(pages) + 1))
    parts = {
        "[Content_Types].xml": _TYPES.format(overrides),
        "_rels/.rels": _RELS.format(rel(1, "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'{head}<p:presentation {_P}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _RELS.format(rel(1, "slideMaster", "slideMasters/slideMaster1.xml") + "".join(rel(i + 1, "slide", f"slides/slide{i}.xml") for i in range(1, len(pages) + 1))),
        "ppt/slideMasters/slideMaster1.xml": f'{head}<p:sldMaster {_P}><p:cSld><p:spTree>{_TREE}</p:spTree></p:cSld>{_MAP}<p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>',
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": _RELS.format(rel(1, "slideLayout", "../slideLayouts/slideLayout1.xml") + rel(2, "theme", "../theme/theme1.xml")),
        "ppt/slideLayouts/slideLayout1.xml": f'{head}<p:sldLayout {_P}><p:cSld><p:spTree>{_TREE}</p:spTree></p:cSld></p:sldLayout>',
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": _RELS.format(rel(1, "slideMaster", "../slideMasters/slideMaster1.xml")),
        "ppt/theme/theme1.xml": head + _theme(),
    }
    for i, (title, lines) in enumerate(pages, 1):
        body = _box(2, 365760, 914400, 2800, [title]) + _box(3, 1463040, 4937760, 1600, lines)
        parts[f"ppt/slides/slide{i}.xml"] = f"{head}<p:sld {_P}><p:cSld><p:spTree>{_TREE}{body}</p:spTree></p:cSld></p:sld>"
        parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = _RELS.format(rel(1, "slideLayout", "../slideLayouts/slideLayout1.xml"))
    return _package(parts)


#: What a report can be written as.
WRITERS = {"pdf": pdf, "docx": docx, "pptx": pptx}
