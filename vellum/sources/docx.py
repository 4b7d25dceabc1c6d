"""DOCX files by the standard library: facts of a file's XML as rows, new files from lines, and edits of a file in place."""

from __future__ import annotations

import copy
import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Twentieths of a point in a millimetre.
TWIPS = 1440 / 25.4
FACTS = "doc_id string, kind string, i int, text string, style string, alignment string, first_line_indent_mm double, line_spacing double, font_size_pt double, font_family string, bold boolean, non_black boolean, has_math boolean, table_index int, row_index int, cell_index int, width_mm double, height_mm double, left_mm double, right_mm double, top_mm double, bottom_mm double, page_field boolean, footer_alignment string, header_field boolean, first_field boolean, title_page boolean, page_start int, drawing boolean, error string"
FIELDS = [x.split()[0] for x in FACTS.split(", ")]


def _val(e, path: str, attr: str = "val") -> str | None:
    x = e.find(path) if e is not None else None
    return None if x is None else x.get(W + attr)


#: What elements of a run say; None: their own text.
SAID = {W + "t": None, M + "t": None, W + "tab": "\t", W + "br": "\n"}


def _text(p) -> str:
    return "".join([SAID[t.tag] or t.text or "" for t in p.iter() if t.tag in SAID])


class Styles:
    """Effective properties of a paragraph: the run's own, its style's, and those the styles are based on."""

    def __init__(self, root):
        self.by = {s.get(W + "styleId"): s for s in root.iter(W + "style")} if root is not None else {}

    def chain(self, name: str | None) -> Iterator:
        seen = set()
        while name in self.by and name not in seen:
            seen.add(name)
            yield self.by[name]
            name = _val(self.by[name], W + "basedOn")

    def name(self, style: str | None) -> str | None:
        return _val(self.by[style], W + "name") if style in self.by else style

    def first(self, own, style: str | None, part: str, path: str, attr: str = "val") -> str | None:
        v = _val(own, path, attr)
        if v is not None or style not in self.by:
            return v
        every = (_val(s.find(W + part), path, attr) for s in self.chain(style))
        return next((v for v in every if v is not None), None)


def _number(v: str | None) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


#: Elements of a paragraph that are drawn.
DRAWN = {W + k for k in ("drawing", "object", "pict")}


def _paragraph(p, styles: Styles) -> dict:
    pr = p.find(W + "pPr")
    style = _val(pr, W + "pStyle")
    get = lambda path, attr="val": styles.first(pr, style, "pPr", path, attr)
    indent, spacing = _number(get(W + "ind", "firstLine")), _number(get(W + "spacing", "line"))
    sizes, fonts, bold, color = [], [], False, False
    for r in p.iter(W + "r"):
        if not _text(r).strip():
            continue
        own = r.find(W + "rPr")
        rs = _val(own, W + "rStyle") or style
        f = lambda path, attr="val": styles.first(own, rs, "rPr", path, attr)  # noqa: B023, E731
        if (s := _number(f(W + "sz"))) is not None:
            sizes.append(s / 2)
        if family := f(W + "rFonts", "ascii"):
            fonts.append(family)
        b = own.find(W + "b") if own is not None else None
        bold |= b is not None and b.get(W + "val", "1") not in ("0", "false")
        color |= (f(W + "color") or "auto").lower() not in ("auto", "000000")
    jc, tags = get(W + "jc"), {e.tag for e in p.iter()}
    return {
        "text": _text(p), "style": styles.name(style), "alignment": {
            "both": "justify", "start": "left", "end": "right", None: "unspecified",
        }.get(jc, jc), "first_line_indent_mm": None if indent is None else round(indent / TWIPS, 1), "line_spacing": None if spacing is None else round(spacing / 240, 2),
        "font_size_pt": min(sizes, default=None), "font_family": fonts[0] if fonts else None, "bold": bold, "non_black": color, "has_math": M + "oMath" in tags, "drawing": not tags.isdisjoint(DRAWN),
    }


def _page_field(xml: bytes) -> bool:
    t = xml.upper()
    return b"PAGE" in t and (b"INSTRTEXT" in t or b"FLDSIMPLE" in t)


def _field_paragraph(xml: bytes):
    """(whether a header or footer has a page field, the paragraph that holds it)."""
    if not _page_field(xml):
        return False, None
    return True, next((p for p in ET.fromstring(xml).iter(W + "p") if _page_field(ET.tostring(p))), None)


#: Most files of a collection have the same few headers and footers; what is remembered is read only and small.
_remembered = lru_cache(64)(_field_paragraph)


class PageParts:
    """Headers and footers of a file's sections; a section without one of a kind has that of the section before."""

    def __init__(self, z: zipfile.ZipFile, styles: Styles):
        self.z, self.styles, self.names, self.own = z, styles, set(z.namelist()), {}
        self.rels = {}
        if "word/_rels/document.xml.rels" in self.names:
            self.rels = {r.get("Id"): f"word/{r.get('Target')}" for r in ET.fromstring(z.read("word/_rels/document.xml.rels"))}
        settings = ET.fromstring(z.read("word/settings.xml")) if "word/settings.xml" in self.names else None
        self.even = settings is not None and settings.find(W + "evenAndOddHeaders") is not None

    def field(self, part: str, kind: str) -> tuple[bool, str | None]:
        """(whether the part has a page field, the alignment of its paragraph)."""
        name = self.own.get((part, kind))
        if name not in self.names:
            return False, None
        xml = self.z.read(name)
        has, p = (_remembered if len(xml) <= 4096 else _field_paragraph)(xml)
        return has, None if p is None else _paragraph(p, self.styles)["alignment"]

    def of(self, section) -> dict:
        for part in ("header", "footer"):
            for r in section.findall(f"{W}{part}Reference"):
                self.own[part, r.get(W + "type", "default")] = self.rels.get(r.get(R + "id"))
        # even pages have parts of their own only where the file says so
        kinds = ("default", "even") if self.even else ("default",)
        feet, heads = [self.field("footer", k) for k in kinds], [self.field("header", k) for k in kinds]
        return {
            "page_field": any(f for f, _ in feet), "footer_alignment": next((a for f, a in feet if f), None),
            "header_field": any(f for f, _ in heads), "first_field": self.field("footer", "first")[0] or self.field("header", "first")[0],
        }


def facts(content: bytes) -> list[dict]:
    """Rows of a file: its paragraphs (i counts empty ones), table cells' paragraphs (i from 10000), sections."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
        styles = Styles(ET.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in names else None)
        parts = PageParts(z, styles)
        out, i, t, cell = [], 0, 0, 9999
        for e in body:
            if e.tag == W + "p":
                i += 1
                out.append({"kind": "paragraph", "i": i, **_paragraph(e, styles)})
            elif e.tag == W + "tbl":
                out.append({"kind": "table", "i": i, "table_index": t, "text": ""})
                for r, row in enumerate(e.findall(W + "tr")):
                    for c, tc in enumerate(row.findall(W + "tc")):
                        for p in tc.findall(W + "p"):
                            cell += 1
                            out.append(
                                {"kind": "cell", "i": cell, "table_index": t, "row_index": r, "cell_index": c, **_paragraph(p, styles)}
                            )
                t += 1
        for n, s in enumerate(body.iter(W + "sectPr")):
            mm = lambda path, attr: None if (v := _number(_val(s, path, attr))) is None else round(v / TWIPS, 1)  # noqa: B023, E731
            start = _number(_val(s, W + "pgNumType", "start"))
            out.append(
                {
                    "kind": "section", "i": n, "width_mm": mm(W + "pgSz", "w"), "height_mm": mm(W + "pgSz", "h"),
                    "left_mm": mm(W + "pgMar", "left"), "right_mm": mm(W + "pgMar", "right"),
                    "top_mm": mm(W + "pgMar", "top"), "bottom_mm": mm(W + "pgMar", "bottom"), **parts.of(s),
                    "title_page": s.find(W + "titlePg") is not None, "page_start": None if start is None else int(start),
                }
            )
        return out


def document_text(content: bytes) -> tuple[str | None, str | None]:
    """(text, error): paragraphs by line; a broken file gives what its XML text shows and why it is broken."""
    try:
        return "\n".join(f["text"] for f in facts(content) if f["kind"] in ("paragraph", "cell") and f["text"].strip()), None
    except Exception as why:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                raw = z.read("word/document.xml").decode("utf-8", "replace")
            return "\n".join(filter(None, (re.sub(r"<[^>]+>", "", p).strip() for p in raw.split("</w:p>")))), str(why)
        except Exception:
            return None, str(why)


#: Rows of facts, and bytes of files, that a worker gathers before it hands them on.
MOST_ROWS, MOST_BYTES = 4096, 1 << 22


def _rows(batches) -> Iterator[tuple]:
    """The rows of Arrow batches, of which only one at a time is made Python objects."""
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(_structs(c[i]) if pa.types.is_list(c.type) and pa.types.is_struct(c.type.value_type) else c[i].as_py() for c in b.columns)


def _structs(x: pa.ListScalar) -> list[dict] | None:
    """A list of structs as dicts, made field by field: that is several times as quick as one by one."""
    v = x.values
    if v is None or v.null_count or not len(v):
        return x.as_py()
    names = [f.name for f in v.type]
    return [dict(zip(names, row, strict=True)) for row in zip(*(f.to_pylist() for f in v.flatten()), strict=True)]


def _made(batches, make) -> Iterator[pa.RecordBatch]:
    """(doc_id, content) of the rows, content by make(the other columns); handed on once MOST_BYTES are gathered."""
    kind, ids, files, size = None, [], [], 0

    def seen():
        nonlocal kind
        for b in batches:
            kind = b.schema.field(0).type
            yield b

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(files, pa.binary())], ["doc_id", "content"])

    for doc, *own in _rows(seen()):
        ids.append(doc)
        files.append(make(*own))
        size += len(files[-1])
        if size >= MOST_BYTES:
            yield batch()
            ids, files, size = [], [], 0
    if ids:
        yield batch()


def read_facts(files: DataFrame) -> DataFrame:
    """(doc_id, content) as rows of FACTS; a file that can't be read is one row of kind 'error'."""

    def run(batches):
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        cols: dict[str, list] = {k: [] for k in FIELDS}

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(cols[n], kinds[t]) for n, t in (x.split() for x in FACTS.split(", "))], FIELDS)

        for doc, content in _rows(batches):
            try:
                rows = facts(content) or [{"kind": "empty"}]
            except Exception as why:
                rows = [{"kind": "error", "error": str(why)}]
            for k in FIELDS:
                cols[k].extend([doc] * len(rows) if k == "doc_id" else [r.get(k) for r in rows])
            if len(cols["kind"]) >= MOST_ROWS:
                yield batch()
                cols = {k: [] for k in FIELDS}
        if cols["kind"]:
            yield batch()

    return files.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, FACTS)


TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def build(lines: list[str]) -> bytes:
    """A minimal file with one paragraph for each line; the same lines give the same bytes."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t, False)}</w:t></w:r></w:p>' for t in lines)
    doc = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("[Content_Types].xml", TYPES), ("_rels/.rels", RELS), ("word/document.xml", doc)):
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def written(lines: DataFrame) -> DataFrame:
    """(doc_id, content) of (doc_id, line, text): the files themselves."""
    g = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]).alias("lines"))

    return g.mapInArrow(lambda batches: _made(batches, build), f"doc_id {lines.schema['doc_id'].dataType.simpleString()}, content binary")


def _field_part(tag: str, alignment: str | None) -> str:
    """A header or footer with a page number."""
    jc = f'<w:pPr><w:jc w:val="{JC.get(alignment, alignment)}"/></w:pPr>' if alignment and alignment != "unspecified" else ""
    run = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
    return f'<?xml version="1.0" encoding="UTF-8"?><w:{tag} xmlns:w="{W[1:-1]}"><w:p>{jc}{run}</w:p></w:{tag}>'


#: Alignments by their names in the format.
JC = {"justify": "both"}
#: Columns of a body item and of a page, for compose().
ITEM = "i int, sub int, kind string, text string, style string, alignment string, first_line_indent_mm double, line_spacing double, font_size_pt double, font_family string, bold boolean, non_black boolean, drawing boolean"
PAGE = "width_mm double, height_mm double, left_mm double, right_mm double, top_mm double, bottom_mm double, page_field boolean, footer_alignment string, header_field boolean, first_field boolean, title_page boolean, page_start int"


def _item(x: dict) -> str:
    own = []
    if x.get("style"):
        own.append(f'<w:pStyle w:val="{escape(x["style"])}"/>')
    if x.get("line_spacing") is not None:
        own.append(f'<w:spacing w:line="{round(240 * x["line_spacing"])}" w:lineRule="auto"/>')
    if x.get("first_line_indent_mm") is not None:
        own.append(f'<w:ind w:firstLine="{round(x["first_line_indent_mm"] * TWIPS)}"/>')
    if x.get("alignment") and x["alignment"] != "unspecified":
        own.append(f'<w:jc w:val="{JC.get(x["alignment"], x["alignment"])}"/>')
    run = []
    if x.get("font_family"):
        run.append(f'<w:rFonts w:ascii="{escape(x["font_family"])}" w:hAnsi="{escape(x["font_family"])}"/>')
    if x.get("bold"):
        run.append("<w:b/>")
    if x.get("non_black"):
        run.append('<w:color w:val="FF0000"/>')
    if x.get("font_size_pt") is not None:
        run.append(f'<w:sz w:val="{round(2 * x["font_size_pt"])}"/>')
    said = f'<w:t xml:space="preserve">{escape(x["text"], False)}</w:t>' if x.get("text") else ""
    runs = f"<w:r><w:rPr>{''.join(run)}</w:rPr>{'<w:drawing/>' if x.get('drawing') else ''}{said}</w:r>" if said or x.get("drawing") else ""
    p = f"<w:p><w:pPr>{''.join(own)}</w:pPr>{runs}</w:p>"
    # a table of one header cell and one cell below it
    return f"<w:tbl><w:tr><w:tc>{p}</w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>" if x.get("kind") == "table" else p


def compose(items: list[dict], page: dict) -> bytes:
    """A file of laid out paragraphs and tables (ITEM), on one kind of page (PAGE); the same rows give the same bytes."""
    parts, rels, refs = {}, [], []
    for name, has, tag, kind, alignment in (
        ("footer1", page.get("page_field"), "ftr", "footer", page.get("footer_alignment")), ("header1", page.get("header_field"), "hdr", "header", "center"),
        ("footer2", page.get("first_field"), "ftr", "footer", "center"),
    ):
        if has:
            parts[f"word/{name}.xml"] = _field_part(tag, alignment)
            rels.append(f'<Relationship Id="{name}" Type="{R[1:-1]}/{kind}" Target="{name}.xml"/>')
            refs.append(f'<w:{kind}Reference w:type="{"first" if name == "footer2" else "default"}" r:id="{name}"/>')
    twips = lambda k: None if page.get(k) is None else round(page[k] * TWIPS)
    def said(tag: str, **values) -> str:
        return f"<w:{tag}{''.join(f' w:{k}=\"{v}\"' for k, v in values.items() if v is not None)}/>" if any(v is not None for v in values.values()) else ""

    section = "".join(refs) + said("pgSz", w=twips("width_mm"), h=twips("height_mm")) + said(
        "pgMar", left=twips("left_mm"), right=twips("right_mm"), top=twips("top_mm"), bottom=twips("bottom_mm"),
    ) + said("pgNumType", start=page.get("page_start")) + ("<w:titlePg/>" if page.get("title_page") else "")
    body = "".join(map(_item, items))
    doc = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}" xmlns:r="{R[1:-1]}"><w:body>{body}<w:sectPr>{section}</w:sectPr></w:body></w:document>'
    kinds = "".join(f'<Override PartName="/{n}" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{"footer" if "footer" in n else "header"}+xml"/>' for n in parts)
    links = f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(rels)}</Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("[Content_Types].xml", TYPES.replace("</Types>", kinds + "</Types>")), ("_rels/.rels", RELS), ("word/document.xml", doc), ("word/_rels/document.xml.rels", links), *parts.items()):
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def composed(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, content): files of items (doc_id and ITEM) and pages (doc_id and PAGE, one row a document)."""
    def row(columns: str):
        return F.struct(*(F.col(c).cast(k).alias(c) for c, k in (x.split() for x in columns.split(", "))))

    g = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(row(ITEM))).alias("items"))
    g = g.join(pages.select("doc_id", row(PAGE).alias("page")), "doc_id", "left")

    run = lambda batches: _made(batches, lambda items, page: compose(items, page or {}))
    return g.mapInArrow(run, f"doc_id {items.schema['doc_id'].dataType.simpleString()}, content binary")


def _child(e, tag: str):
    x = e.find(tag)
    if x is None:
        x = ET.Element(tag)
        e.insert(0, x) if tag == W + "pPr" or tag == W + "rPr" else e.append(x)
    return x


def _set_text(p, text: str) -> None:
    """The paragraph's text replaced, its properties kept: the first run carries it."""
    runs = p.findall(W + "r")
    if not runs:
        runs = [ET.SubElement(p, W + "r")]
    for r in runs:
        for t in [x for x in r if x.tag in (W + "t", W + "tab", W + "br")]:
            r.remove(t)
    t = ET.SubElement(runs[0], W + "t")
    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    t.text = text


#: A sentence that leads up to a formula, the formula, and what follows it.
SENTENCE = re.compile(
    r"^(.*?(?:формуле|формула|равно|имеем|получаем|:)\s+)?([^=]{1,40}=.*?)(?:([,.;]\s*где\b.*|\.\s+[А-ЯЁA-Z].*))?$",
    re.S | re.I,
)


def _split(body, p, text: str, number: str | None) -> None:
    """An inline formula in a centred paragraph of its own: what is before it and after it become its neighbours."""
    m = SENTENCE.match(text.strip())
    if not m:
        return
    before, formula, after = (x.strip() if x else "" for x in m.groups())
    formula = formula.rstrip(" .,;")
    _set_text(p, formula + (f" ({number})" if number and not re.search(r"\([^()]*\d\)$", formula) else ""))
    _child(_child(p, W + "pPr"), W + "jc").set(W + "val", "center")
    at = list(body).index(p)
    for place, words in ((at + 1, after.lstrip(",.; ")), (at, before)):
        if words:
            new = ET.Element(W + "p")
            _set_text(new, words)
            body.insert(place, new)


FOOTER = f'<?xml version="1.0" encoding="UTF-8"?><w:ftr xmlns:w="{W[1:-1]}"><w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p></w:ftr>'


def _page_fields(src: zipfile.ZipFile, body, parts: dict[str, bytes], op: str) -> None:
    """A centred page number in the first section's footer, or headers without one."""
    rels_name, names = "word/_rels/document.xml.rels", set(src.namelist())
    read = lambda n: parts.get(n) or src.read(n)
    space = "http://schemas.openxmlformats.org/package/2006/relationships"
    rels = ET.fromstring(read(rels_name)) if rels_name in names or rels_name in parts else ET.Element(f"{{{space}}}Relationships")
    target = {r.get("Id"): f"word/{r.get('Target')}" for r in rels}
    sections = list(body.iter(W + "sectPr"))
    if op in ("clear_header_field", "hide_first_page"):
        for s in sections:
            first = [f for k in ("header", "footer") for f in s.findall(f"{W}{k}Reference") if f.get(W + "type") == "first"]
            for h in s.findall(W + "headerReference") if op == "clear_header_field" else first:
                n = target.get(h.get(R + "id"))
                if n in names and _page_field(read(n)):
                    x = ET.fromstring(read(n))
                    for q in x.iter(W + "p"):
                        for c in list(q):
                            if c.tag == W + "fldSimple" or c.tag == W + "r" and any(k.tag in (W + "instrText", W + "fldChar") for k in c):
                                q.remove(c)
                    parts[n] = ET.tostring(x, encoding="utf-8", xml_declaration=True)
        return
    feet = [f for s in sections for f in s.findall(W + "footerReference")]
    if op == "center_page_field":
        for n in {target.get(f.get(R + "id")) for f in feet} & names:
            if _page_field(read(n)):
                x = ET.fromstring(read(n))
                for q in x.iter(W + "p"):
                    if _page_field(ET.tostring(q)):
                        _child(_child(q, W + "pPr"), W + "jc").set(W + "val", "center")
                parts[n] = ET.tostring(x, encoding="utf-8", xml_declaration=True)
        return
    # a number on first pages alone doesn't count
    if not sections or any(
        _page_field(read(target[f.get(R + "id")])) for f in feet if f.get(W + "type", "default") == "default" and target.get(f.get(R + "id")) in names
    ):
        return
    parts["word/footerPages.xml"] = FOOTER.encode()
    ET.SubElement(rels, f"{{{space}}}Relationship", {"Id": "rIdPages", "Type": f"{R[1:-1]}/footer", "Target": "footerPages.xml"})
    parts[rels_name] = ET.tostring(rels, encoding="utf-8", xml_declaration=True)
    for s in sections:
        for old in [f for f in s.findall(W + "footerReference") if f.get(W + "type", "default") == "default"]:
            s.remove(old)
        s.insert(0, ET.Element(W + "footerReference", {W + "type": "default", R + "id": "rIdPages"}))
    if "[Content_Types].xml" in names:
        types = ET.fromstring(read("[Content_Types].xml"))
        ET.SubElement(
            types, types.tag.replace("Types", "Override"),
            {
                "PartName": "/word/footerPages.xml",
                "ContentType": "application/vnd.openxmlformats-officedocument.wordprocessingml.footer+xml",
            },
        )
        parts["[Content_Types].xml"] = ET.tostring(types, encoding="utf-8", xml_declaration=True)


def _targets(body):
    """A search for the paragraph of an edit: by index and, if another text than the expected stands there, the nearest with that text."""
    every = [e for e in body if e.tag == W + "p"]
    same: dict[str, list[int]] = {}
    for n, p in enumerate(every, 1):
        same.setdefault(" ".join(_text(p).split()), []).append(n)

    def find(index: int | None, text: str | None):
        here = every[index - 1] if index and 1 <= index <= len(every) else None
        if text is None or here is not None and " ".join(_text(here).split()) == " ".join(text.split()):
            return here
        alike = same.get(" ".join(text.split()), [])
        return every[min(alike, key=lambda n: (abs(n - (index or 0)), n)) - 1] if alike else None

    return find


#: An appendix and its title in one line.
APPENDIX_LINE = re.compile(r"^(приложение\s+[А-ЯЁA-Z])\s*[-–—.]?\s+(\S.*)$", re.I)


def edit(content: bytes, edits: list[dict]) -> bytes:
    """A file after edits (paragraph_index, op, arg); paragraphs with drawings or objects, and native formulas' texts, are left alone."""
    src = zipfile.ZipFile(io.BytesIO(content))
    root = ET.fromstring(src.read("word/document.xml"))
    body = root.find(W + "body")
    find = _targets(body)
    parts: dict[str, bytes] = {}
    # targets are the elements themselves, found before any edit, so inserts and removals don't move them
    for e, p in [(e, find(e.get("paragraph_index"), e.get("text"))) for e in edits]:
        op, arg = e["op"], e.get("arg")
        if op in ("add_page_field", "clear_header_field", "center_page_field"):
            _page_fields(src, body, parts, op)
            continue
        if op == "center_header":
            for row in (t.find(W + "tr") for t in body.iter(W + "tbl")):
                for c in row.iter(W + "p") if row is not None else ():
                    _child(_child(c, W + "pPr"), W + "jc").set(W + "val", "center")
            continue
        if op == "strip_header_period":
            for row in (t.find(W + "tr") for t in body.iter(W + "tbl")):
                for c in row.iter(W + "p") if row is not None else ():
                    if _text(c).rstrip().endswith("."):
                        _set_text(c, _text(c).rstrip(". "))
            continue
        if op in ("set_margins", "set_page"):
            for s in body.iter(W + "sectPr"):
                if op == "set_margins":
                    m = _child(s, W + "pgMar")
                    for k, mm in (("left", 30), ("right", 15), ("top", 20), ("bottom", 20)):
                        m.set(W + k, str(round(mm * TWIPS)))
                else:
                    z = _child(s, W + "pgSz")
                    wide = (_number(z.get(W + "w")) or 0) > (_number(z.get(W + "h")) or 1)
                    for k, mm in (("w", 297 if wide else 210), ("h", 210 if wide else 297)):
                        z.set(W + k, str(round(mm * TWIPS)))
            continue
        if op == "clear_restart":
            for s in body.iter(W + "sectPr"):
                for n in s.findall(W + "pgNumType"):
                    n.attrib.pop(W + "start", None)
            continue
        if op == "hide_first_page":
            for s in list(body.iter(W + "sectPr"))[:1]:
                _child(s, W + "titlePg")
            _page_fields(src, body, parts, op)
            continue
        if p is None or any(p.find(f".//{W}{k}") is not None for k in ("drawing", "object", "pict")):
            continue
        if op == "move_caption_above":
            above = list(body)[: list(body).index(p)]
            table = next((t for t in reversed(above) if t.tag == W + "tbl"), None)
            if table is not None:
                body.remove(p)
                body.insert(list(body).index(table), p)
            continue
        pr = _child(p, W + "pPr")
        if op == "align":
            _child(pr, W + "jc").set(W + "val", {"justify": "both"}.get(arg, arg))
        elif op == "set_indent":
            _child(pr, W + "ind").set(W + "firstLine", str(round(12.5 * TWIPS)))
        elif op == "clear_indent":
            _child(pr, W + "ind").set(W + "firstLine", "0")
        elif op == "set_spacing":
            s = _child(pr, W + "spacing")
            s.set(W + "line", "360")
            s.set(W + "lineRule", "auto")
        elif op in ("set_font", "set_color", "clear_bold"):
            for r in p.iter(W + "r"):
                rp = _child(r, W + "rPr")
                if op == "set_font":
                    _child(rp, W + "rFonts").set(W + "ascii", "Times New Roman")
                    _child(rp, W + "rFonts").set(W + "hAnsi", "Times New Roman")
                    _child(rp, W + "sz").set(W + "val", "24")
                elif op == "set_color":
                    _child(rp, W + "color").set(W + "val", "000000")
                else:
                    _child(rp, W + "b").set(W + "val", "0")
        elif p.find(f".//{M}oMath") is None:
            text = _text(p)
            if op == "replace_text":
                _set_text(p, arg or "")
            elif op == "strip_period":
                _set_text(p, text.rstrip(". "))
            elif op == "upper":
                _set_text(p, text.upper())
            elif op == "strip_number":
                _set_text(p, re.sub(r"^\d+(\.\d+)*\.?\s+", "", text))
            elif op == "where_without_colon":
                _set_text(p, re.sub(r"^(\s*[Гг]де):", r"\1", text))
            elif op == "fix_marker":
                _set_text(p, re.sub(r"^(\s*)[•●▪*]\s*", r"\1- ", re.sub(r"^(\s*(?:\d+|[а-яё]))\.\s+", r"\1) ", text)))
            elif op == "number_formula" and arg:
                _set_text(p, re.sub(r"(\s*\([^()]*\d\)|(?<=\S)\s+\d+(\.\d+)*)\s*$", "", text) + f" ({arg})")
            elif op == "split_appendix":
                m = APPENDIX_LINE.match(text.strip())
                if m:
                    below = copy.deepcopy(p)
                    _set_text(p, m[1])
                    _set_text(below, m[2])
                    for x in (p, below):
                        _child(_child(x, W + "pPr"), W + "jc").set(W + "val", "center")
                    body.insert(list(body).index(p) + 1, below)
            elif op == "split_formula":
                _split(body, p, text, arg)
            elif op == "insert_reference":
                new = ET.Element(W + "p")
                _set_text(new, f"Расчет ведут по формуле ({arg or 1}).")
                body.insert(list(body).index(p), new)
            elif op in ("insert_before", "insert_after"):
                new = ET.Element(W + "p")
                _set_text(new, arg or "")
                body.insert(list(body).index(p) + (op == "insert_after"), new)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts["word/document.xml"] = ET.tostring(root, encoding="utf-8", xml_declaration=True)
        for i in src.infolist():
            z.writestr(i, parts.pop(i.filename) if i.filename in parts else src.read(i.filename))
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def edited(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, content) after the plan's edits (doc_id, paragraph_index, op, arg, step; text, if it has it), each file in one piece."""
    own = ["step", "paragraph_index", "op", "arg", *(["text"] if "text" in plan.columns else [])]
    g = plan.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("edits"))

    run = lambda batches: _made(batches, lambda content, edits: edit(content, edits or []))
    return files.join(g, "doc_id", "left").select("doc_id", "content", "edits").mapInArrow(
        run, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, content binary",
    )
