"""Files as tables: scans, sniffing and extraction of text and fields.

Files are read by Spark's binaryFile source; formats that need code are decoded in Arrow batches by small
functions, one file at a time, and an error is a row, never a failed job.
"""

from __future__ import annotations

import hashlib
import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension

#: Names that scans skip, text formats, and the first bytes of known formats.
JUNK = ["thumbs.db", "desktop.ini", ".ds_store"]
TEXT_KINDS = ["txt", "text", "csv", "tsv", "rtf", "log", "md", "ini"]
OFFICE_KINDS = ["docx", "xlsx", "pptx", "odt", "ods", "odp"]
SIGNATURES = {"%PDF": "pdf", "PK\x03\x04": "zip", "\xd0\xcf\x11\xe0": "ole", "\x89PNG": "png", "\xff\xd8\xff": "jpg", "GIF8": "gif", "BM": "bmp", "II*\x00": "tif", "MM\x00*": "tif", "8BPS": "psd", "AC10": "dwg", "ISO-": "ifc"}
MAX_TEXT, MAX_FILE, MAX_OFFICE = 2 << 20, 512 << 20, 350_000


def scan(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, file_name, ext, size_bytes, modified_at, skipped): files below a root; content is not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    below = F.replace(F.col("path"), F.lit(root), F.lit(""))
    skipped = F.when(below.rlike(r"/\.[^/]"), "hidden").when(F.lower(name).isin(JUNK), "system_file")
    return rows.select("path", name.alias("file_name"), extension(name).alias("ext"), F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("modified_at"), skipped.alias("skipped"))


def changed(scanned: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Files whose path, size and time are not catalogued as such."""
    return scanned.filter("skipped is null").join(fingerprints.select("path", "size_bytes", "modified_at"), ["path", "size_bytes", "modified_at"], "left_anti")


def sniff(content: Column) -> Column:
    """The kind that the first bytes tell."""
    out = F.lit("unknown")
    for sign, kind in SIGNATURES.items():
        raw = sign.encode("latin-1").hex().upper()
        out = F.when(F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(raw)), kind).otherwise(out)
    return out


def csv_delimiter(line: Column) -> Column:
    count = lambda c: F.regexp_count(line, F.lit(c))
    tab, comma, semi = count("\t"), count(","), count(";")
    return F.when((tab >= comma) & (tab >= semi), "\t").when(semi > comma, ";").otherwise(",")


def decode(data: bytes) -> tuple[str, str, bool]:
    """(text, encoding, byte-order mark): by the mark, else UTF-8 if valid, else Windows-1254."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name, True
    try:
        return data.decode("utf-8"), "utf-8", False
    except UnicodeDecodeError:
        return data.decode("cp1254", "replace"), "windows-1254", False


def read_text(data: bytes, ext: str) -> tuple[str, dict[str, str]]:
    text, name, mark = decode(data[:MAX_TEXT])
    lines = text.splitlines()
    fields = {"char_count": len(text), "line_count": len(lines), "word_count": len(text.split()), "encoding_hint": name, "has_bom": str(mark).lower(), "is_utf8": str(name == "utf-8").lower(), "preview": text[:200]}
    if ext in ("csv", "tsv") and lines:
        head = lines[0]
        tab, comma, semi = head.count("\t"), head.count(","), head.count(";")
        cut = "\t" if tab >= comma and tab >= semi else ";" if semi > comma else ","
        fields |= {"csv_row_count": sum(bool(x.strip()) for x in lines), "csv_column_count": len(head.split(cut))}
    return text, {k: str(v) for k, v in fields.items()}


def _step_strings(text: str) -> list[str | None]:
    """The quoted parts of a STEP argument list in order; '' within quotes is one quote."""
    return [x.replace("''", "'") for x in re.findall(r"'((?:[^']|'')*)'", text)]


def _header(text: str, name: str) -> str:
    found = re.search(rf"{name}\s*\((.*?)\)\s*;", text, re.S)
    return found[1] if found else ""


def read_ifc(data: bytes, ext: str) -> tuple[str, dict[str, str]]:
    """Header fields, names and counts of a STEP file's entities; the text is what people search for."""
    text = decode(data)[0]
    kinds = pd.Series(re.findall(r"^#\d+\s*=\s*([A-Z0-9_]+)\s*\(", text, re.M), dtype=object).value_counts()
    fields = {"total_entities": str(int(kinds.sum()))}
    if len(kinds):
        fields["top_entities"] = ", ".join(f"{k}:{n}" for k, n in sorted(kinds.items(), key=lambda x: (-x[1], x[0]))[:10])
    fields |= {f"{n}_count": str(int(kinds.get(k, 0))) for n, k in (("storey", "IFCBUILDINGSTOREY"), ("space", "IFCSPACE"))}
    # FILE_NAME: name, time, (authors), (organizations), preprocessor, originating system, authorization.
    lists = re.findall(r"\(([^()]*)\)", _header(text, "FILE_NAME"))
    after = _step_strings(re.sub(r"\([^()]*\)", "()", _header(text, "FILE_NAME")))
    found = {
        "schema": next(iter(_step_strings(_header(text, "FILE_SCHEMA"))), ""),
        "description": next(iter(_step_strings(_header(text, "FILE_DESCRIPTION"))), ""),
        "author": ", ".join(filter(None, _step_strings(lists[0]))) if lists else "",
        "organization": ", ".join(filter(None, _step_strings(lists[1]))) if len(lists) > 1 else "",
        "originating_system": after[3] if len(after) > 3 else "",
    }
    for name, kind in (("project_name", "IFCPROJECT"), ("site_name", "IFCSITE"), ("building_name", "IFCBUILDING")):
        m = re.search(rf"=\s*{kind}\s*\(\s*'[^']*'\s*,[^,]*,\s*'((?:[^']|'')*)'", text)
        found[name] = m[1].replace("''", "'") if m else ""
    fields |= {k: v for k, v in found.items() if v}
    storeys = [x for x in re.findall(r"=\s*IFCBUILDINGSTOREY\s*\(\s*'[^']*'\s*,[^,]*,\s*'((?:[^']|'')*)'", text) if x][:50]
    if storeys:
        fields["storey_names"] = "; ".join(storeys)
    said = [found[k] for k in ("project_name", "site_name", "building_name", "author", "organization", "originating_system", "description")]
    return "\n".join([x for x in said if x] + storeys), fields


def read_dxf(data: bytes, ext: str) -> tuple[str, dict[str, str]]:
    """Version, layers, blocks and texts from a drawing's (code, value) pairs."""
    lines = [x.strip() for x in decode(data)[0].splitlines()]
    pairs = [(int(c), v) for c, v in zip(lines[::2], lines[1::2]) if re.fullmatch(r"-?\d+", c)]
    layers, blocks, texts, section, version = set(), set(), [], "", ""
    kind = ""
    for i, (code, value) in enumerate(pairs):
        if code == 0:
            kind = value
        elif code == 2 and kind == "SECTION":
            section = value
        elif code == 2 and kind == "LAYER":
            layers.add(value)
        elif code == 2 and kind == "BLOCK" and not value.startswith("*"):
            blocks.add(value)
        elif code == 1 and kind in ("TEXT", "MTEXT", "ATTRIB"):
            texts.append(value)
        elif code == 9:  # a header variable; its value follows
            kind = ""
            if value == "$ACADVER" and i + 1 < len(pairs):
                version = pairs[i + 1][1]
    return "\n".join(texts), {"version": version, "layers": ", ".join(sorted(layers)), "blocks": ", ".join(sorted(blocks)), "text_count": str(len(texts))}


def read_office(data: bytes, ext: str) -> tuple[str, dict[str, str]]:
    """Text and core properties of OOXML and ODF files."""
    fields: dict[str, str] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        wanted = [n for n in names if re.fullmatch(r"word/document\.xml|xl/sharedStrings\.xml|ppt/slides/slide\d+\.xml|content\.xml", n)]
        parts = ["".join(e.text or "" if e.text else "" for e in ElementTree.fromstring(z.read(n)).iter()) if n.startswith("xl/") else _blocks(z.read(n)) for n in wanted]
        for n in ("docProps/core.xml", "meta.xml"):
            if n in names:
                for e in ElementTree.fromstring(z.read(n)).iter():
                    tag = e.tag.rpartition("}")[2]
                    if e.text and tag in ("title", "creator", "created", "modified", "subject", "creation-date", "date"):
                        fields.setdefault(tag.replace("-", "_"), e.text)
    return "\n".join(parts)[:MAX_OFFICE], fields


def _blocks(raw: bytes) -> str:
    """Paragraphs of an XML document, a line each."""
    lines = []
    for e in ElementTree.fromstring(raw).iter():
        if e.tag.rpartition("}")[2] in ("p", "h"):
            lines.append("".join(e.itertext()))
    return "\n".join(x for x in lines if x.strip())


#: Formats and their decoders; users add their own.
EXTRACTORS: dict[str, Callable[[bytes, str], tuple[str, dict[str, str]]]] = {**dict.fromkeys(TEXT_KINDS, read_text), "ifc": read_ifc, "dxf": read_dxf, **dict.fromkeys(OFFICE_KINDS, read_office)}


def extract(spark: SparkSession, root: str | list[str], extractors: dict | None = None) -> DataFrame:
    """(path, ext, content_hash, text, fields, error) of the files below a root, or of some files again.

    A file is read once, for its hash and its text. One of an unknown format is a row without text, one
    too large a row without both. Spark's setting spark.sql.execution.arrow.maxRecordsPerBatch bounds the
    files that a task holds at once.
    """
    known = extractors or EXTRACTORS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for path, ext, content in zip(frame["path"], frame["ext"], frame["content"]):
                text, fields, error = None, {}, None
                try:
                    if ext in known and content is not None:
                        text, fields = known[ext](bytes(content), ext)
                except Exception as e:  # one bad file is a row
                    error = f"{type(e).__name__}: {e}"[:500]
                digest = None if content is None else hashlib.sha256(content).hexdigest()
                out.append((path, ext, digest, text, fields, error))
            yield pd.DataFrame(out, columns=["path", "ext", "content_hash", "text", "fields", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = extension(F.element_at(F.split("path", "/"), -1))
    rows = files.select("path", ext.alias("ext"), F.when((F.col("length") <= MAX_FILE), F.col("content")).alias("content"))
    return rows.mapInPandas(run, "path string, ext string, content_hash string, text string, fields map<string,string>, error string")


def extract_html(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, title, text): pages without tags, scripts and styles; entities are resolved."""

    @F.pandas_udf("string")
    def unescape(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    c = F.regexp_replace(F.col(column), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    return df.select(key, F.nullif(F.regexp_extract(column, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")).alias("title"), unescape(plain).alias("text"))
