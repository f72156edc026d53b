"""Page texts out of PDF files, as far as plain Python gets: cross-referenced or compressed objects, Flate streams and text operators with simple fonts or a ToUnicode map.

Encrypted files, scans and fonts without a map have no text here; such a page is empty, as is one that
cannot be read. A full extractor goes into the same slot: any function from bytes to a list of page texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T

Extract = Callable[[bytes], list[str]]

OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*)\bendstream", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
ESCAPES = {b"n": "\n", b"r": "\r", b"t": "\t", b"b": "\b", b"f": "\f"}
GAP = 180  # thousandths of an em between two strings that stand for a blank


def _inflated(head: bytes, body: bytes) -> bytes:
    if b"FlateDecode" in head:
        return zlib.decompressobj().decompress(body)
    return b"" if b"/Filter" in head else body


def _objects(raw: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[3] for m in OBJECT.finditer(raw)}
    for said in [*found.values()]:
        if b"/ObjStm" in said and (m := STREAM.search(said)):
            data = _inflated(m[1], m[2])
            n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", m[1])[1]) for k in (b"N", b"First"))
            places = [int(x) for x in data[:first].split()[: 2 * n]]
            starts = [*places[1::2], len(data) - first]
            found |= {k: data[first + a : first + b] for k, a, b in zip(places[::2], starts, starts[1:])}
    return found


def _pages(objects: dict[int, bytes]) -> Iterator[bytes]:
    roots = [v for v in objects.values() if re.search(rb"/Type\s*/Catalog\b", v)]
    seen: set[int] = set()

    def walk(number: int) -> Iterator[bytes]:
        node = objects.get(number, b"")
        if number in seen:
            return
        seen.add(number)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", node, re.S)
        if kids:
            for m in REFERENCE.finditer(kids[1]):
                yield from walk(int(m[1]))
        elif node:
            yield node

    for root in roots[-1:]:
        if m := re.search(rb"/Pages\s+(\d+)", root):
            yield from walk(int(m[1]))


def _map(cmap: bytes) -> dict[bytes, str]:
    """Codes to text of a ToUnicode map."""
    out: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(a.decode())] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            low, size = int(a, 16), len(a) // 2
            for k in range(min(int(b, 16) - low + 1, 1 << 16)):
                out[(low + k).to_bytes(size, "big")] = chr(int(c, 16) + k)
    return out


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def escape(m: re.Match) -> bytes:
        x = m[1]
        if x.isdigit():
            return bytes([int(x, 8) & 255])
        return ESCAPES[x].encode() if x in ESCAPES else b"" if x in (b"\n", b"\r\n") else x

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", escape, token[1:-1], flags=re.S)


def _said(raw: bytes, codes: dict[bytes, str] | None) -> str:
    if not codes:
        return raw.decode("cp1252", "replace")
    size = len(next(iter(codes)))
    return "".join(codes.get(raw[k : k + size], "") for k in range(0, len(raw), size))


def _page_text(page: bytes, objects: dict[int, bytes]) -> str:
    m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
    data = b""
    for r in REFERENCE.finditer(m[1]) if m else ():
        if s := STREAM.search(objects.get(int(r[1]), b"")):
            data += _inflated(s[1], s[2]) + b"\n"
    fonts: dict[bytes, dict[bytes, str]] = {}
    said = page
    if m := re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", page):
        said += objects.get(int(m[1]), b"")
    if m := re.search(rb"/Font\s+(\d+)\s+\d+\s+R", said):
        said += objects.get(int(m[1]), b"")
    for name, number in re.findall(rb"(/[^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", said):
        if m := re.search(rb"/ToUnicode\s+(\d+)", objects.get(int(number), b"")):
            if s := STREAM.search(objects.get(int(m[1]), b"")):
                fonts[name] = _map(_inflated(s[1], s[2]))
    out: list[str] = []
    held: list[bytes] = []
    codes = None
    for token in (t[0] for t in TOKEN.finditer(data)):
        if token[:1] in (b"(", b"<", b"/", b"[", b"]") or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            held.append(token)
            continue
        if token == b"Tf":
            codes = next((fonts.get(t) for t in reversed(held) if t.startswith(b"/")), None)
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append("\n")
            for t in held:
                if t[:1] in (b"(", b"<"):
                    out.append(_said(_string(t), codes))
                elif token == b"TJ" and t[:1] not in (b"[", b"]", b"/") and -float(t) > GAP:
                    out.append(" ")
        elif token in (b"Td", b"TD") and len(held) >= 2:
            out.append("\n" if float(held[-1]) else " ")
        elif token in (b"T*", b"Tm", b"ET"):
            out.append("\n")
        held.clear()
    return re.sub(r" *\n+ *", "\n", "".join(out)).strip()


def page_texts(raw: bytes) -> list[str]:
    """The text of each page; a page that cannot be read is ''."""
    try:
        objects = _objects(raw)
        pages = [*_pages(objects)]
    except Exception:  # a damaged file has no pages
        return []
    out = []
    for page in pages:
        try:
            out.append(_page_text(page, objects))
        except Exception:  # one bad page does not lose the others
            out.append("")
    return out


def pages_of(raw: Column, extract: Extract = page_texts) -> Column:
    """Bytes of a PDF -> array of page texts."""

    def each(files: pd.Series) -> pd.Series:
        return files.map(lambda b: None if b is None else extract(bytes(b)))

    return F.pandas_udf(each, "array<string>")(raw)


def read_pages(spark: SparkSession, path: str, extract: Extract = page_texts) -> DataFrame:
    """paper_id, pages of every PDF file under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("paper_id"), pages_of("content", extract).alias("pages"))


def full_text(raw: Column, extract: Extract = page_texts) -> Column:
    """The text of a cited work's PDF, null if there is none."""
    return T.blank_to_null(T.strip(F.array_join(pages_of(raw, extract), "\n")))
