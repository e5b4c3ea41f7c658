"""Filing HTML to typed blocks and section-aware chunks.

Blocks come from one pass of the standard library's HTML reader; the chunker walks a document's blocks
once.  Both are generators inside ``mapInArrow``: a document is the unit of parallelism, nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import ids

# Sizes and patterns of filings.
MAX_TEXT = 3500
SLICE = 4 << 20
MIN_TEXT = 80
MAX_SUBSECTION = 80
MAX_CAPTION = 400
MAX_FOOTER = 400
MAX_HEADER = 200
PREFACE_WINDOW = 800
ITEM = re.compile(r"^item\s+\d+[a-z]?\.?\s*", re.I)
PART = re.compile(r"^part\s+[ivx]+\b", re.I)
NOTE = re.compile(r"^Note\s+\d+\b", re.I)
CHROME = re.compile(r"Form\s+10-[QK]\s*\|\s*\d+|\|\s*Q[1-4]\s+20\d{2}\s+Form\s+10-[QK]", re.I)
PIPED = re.compile(r"[A-Za-z0-9 .,&'\-]+\s*\|\s*.+\|\s*\d+")
CAPTION_START, CAPTION_PARTS = "the following table", ("(in millions", "(dollars in")
CAMEL = re.compile(r"[a-z]+[A-Z]")
FOOTER = re.compile(r"^(\(\d+\)|\*+|†|‡|Note:|Includes\b|Total\b.+\binclude)", re.I)
ALIGN = re.compile(r"text-align\s*:\s*([a-z]+)", re.I)
BOLD = re.compile(r"font-weight\s*:\s*(bold|[6-9]00)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
BLOCK_TAGS = frozenset("p div li h1 h2 h3 h4 h5 tr br".split())
NO_SPACE_BEFORE, NO_SPACE_AFTER = frozenset(".,;:)]}%"), frozenset("([{$")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript".split())

BLOCKS = "pos int, kind string, text string, align string, bold boolean"
CHUNKS = "pos int, is_table boolean, section string, subsection string, subsubsection string, text string"


def tidy(text: str) -> str:
    return " ".join(text.replace("\xa0", " ").split())


def joined(nodes: list[str]) -> str:
    """Text nodes as one text.  Where two meet without white space, letters and digits stay one word; other
    neighbours get a space, unless a bracket, a dollar sign or punctuation holds them together."""
    out: list[str] = []
    last = ""
    for node in nodes:
        if last and node and not last[-1].isspace() and not node[0].isspace():
            a, b = last[-1], node[0]
            if not (a.isalnum() and b.isalnum()) and a not in NO_SPACE_AFTER and b not in NO_SPACE_BEFORE:
                out.append(" ")
        out.append(node)
        last = node or last
    return tidy("".join(out))


@dataclass
class Block:
    kind: str
    text: str
    align: str | None = None
    bold: bool = False


def markdown(rows: list[list[str]]) -> str:
    """A table with its first row as header; rows without text are left out."""
    rows = [[c.replace("|", "\\|") for c in r] for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, bool, str | None]] = []  # tag, hidden, bold, align
        self.text: list[str] = []
        self.bold, self.align = False, None
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def _add(self, kind: str, text: str, align: str | None = None, bold: bool = False) -> None:
        last = self.blocks[-1] if self.blocks else None
        if text and not (last and last.kind == kind and last.text == text and len(text) < 200):
            self.blocks.append(Block(kind, text, align, bold))

    def flush(self) -> None:
        self._add("text", joined(self.text), self.align, self.bold)
        self.text, self.bold, self.align = [], False, None

    def _end_cell(self) -> None:
        if self.cell is not None:
            self.tables[-1][-1].append(joined(self.cell))
            self.cell = None

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        style = given.get("style") or ""
        up = self.open[-1] if self.open else ("", False, False, None)
        own = m[1].lower() if (m := ALIGN.search(style)) else (given.get("align") or "").strip().lower() or None
        strong = tag in ("b", "strong") or BOLD.search(style) is not None
        # A block has its own alignment and weight; only what is inside it hands weight on.
        align, bold = (own, strong) if tag in BLOCK_TAGS - {"br"} else (up[3], up[2] or strong)
        state = (tag, up[1] or tag in SKIPPED or HIDDEN.search(style) is not None, bold, align)
        if not state[1]:
            if tag == "table":
                if not self.tables:
                    self.flush()
                    self.tables.append([])
                elif self.cell is not None:
                    self.cell.append(" ")
            elif self.tables:
                if tag == "tr" and self._outer():
                    self._end_cell()
                    self.tables[-1].append([])
                elif tag in ("td", "th") and self._outer():
                    self._end_cell()
                    if not self.tables[-1]:
                        self.tables[-1].append([])
                    self.cell = []
                elif tag in BLOCK_TAGS and self.cell is not None:
                    self.cell.append(" ")
            elif tag in BLOCK_TAGS:
                self.flush()
        if tag not in VOID:
            self.open.append(state)

    def _outer(self) -> bool:
        return sum(t[0] == "table" for t in self.open) == 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        hidden, outer = self.open[at][1], self._outer()
        del self.open[at:]
        if hidden:
            return
        if tag == "table" and outer and self.tables:
            self._end_cell()
            self._add("table", markdown(self.tables.pop()))
        elif self.tables:
            if tag in ("td", "th", "tr") and outer:
                self._end_cell()
        elif tag in BLOCK_TAGS:
            self.flush()

    def handle_data(self, data):
        up = self.open[-1] if self.open else ("", False, False, None)
        if up[1]:
            return
        if self.tables:
            if self.cell is not None:
                self.cell.append(data)
            return
        if data.strip():
            self.bold, self.align = self.bold or up[2], up[3]
        self.text.append(data)


def blocks_of(html: str | None) -> list[Block]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    if reader.tables:
        reader._end_cell()
        reader._add("table", markdown(reader.tables.pop()))
    reader.flush()
    return reader.blocks


def section_title(text: str) -> str | None:
    """The header's text if it opens an Item or a Part."""
    head = re.sub(r"^[\W\d_]{0,6}", "", text)
    return head[:160] if len(text) <= MAX_HEADER and (ITEM.match(head) or PART.match(head)) else None


def is_chrome(text: str) -> bool:
    """Running heads and feet of pages."""
    return CHROME.search(text) is not None or PIPED.fullmatch(text) is not None


def is_subsection(block: Block) -> bool:
    text = block.text
    if len(text) > MAX_SUBSECTION or text.endswith(":") or section_title(text) or is_chrome(text):
        return False
    return block.align == "right" or block.bold and block.align in (None, "left", "justify") and not text.endswith(".")


def is_footer(text: str) -> bool:
    if not text or len(text) > MAX_FOOTER or section_title(text) or is_chrome(text) or CAMEL.match(text):
        return False
    return FOOTER.match(text) is not None or re.match("[a-z]", text) is not None and len(text) <= 200


def is_caption(block: Block) -> bool:
    """A block that titles a table wherever it stands among the lines before it."""
    low = block.text.lower()
    return block.bold or low.endswith(":") or low.startswith(CAPTION_START) or any(x in low for x in CAPTION_PARTS)


def split_long(text: str, limit: int = MAX_TEXT) -> list[str]:
    """Pieces of at most ``limit``, cut at the last blank line past half of it where there is one."""
    out = []
    while len(text) > limit:
        at = text.rfind("\n\n", 0, limit)
        at = at if at > limit // 2 else limit
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [*out, text]


@dataclass
class Chunker:
    """State of one document: where it is, and the prose and preface that wait to be written."""

    section: str = "Document"
    levels: list[str | None] = field(default_factory=lambda: [None, None])
    pinned: bool = False
    prose: list[str] = field(default_factory=list)
    preface: list[Block] = field(default_factory=list)
    out: list[list] = field(default_factory=list)
    after_table: bool = False
    footers: list[str] = field(default_factory=list)

    def emit(self, is_table: bool, text: str, beside: str | None = None) -> None:
        """Adds a chunk under the titles that ``beside`` (default: the text) doesn't hold yet."""
        titles = [t for t in self.levels if t and t not in (text if beside is None else beside)]
        self.out.append([is_table, self.section, *self.levels, "\n\n".join([*titles, text])])

    def flush(self) -> None:
        text = "\n\n".join(self.prose).strip()
        self.prose = []
        for piece in split_long(text):
            if len(piece) >= MIN_TEXT:
                self.emit(False, piece)

    def settle(self, keep: int = 0) -> None:
        """Preface blocks become prose, page chrome aside."""
        cut = len(self.preface) - keep
        self.prose += [b.text for b in self.preface[:cut] if not is_chrome(b.text)]
        self.preface = self.preface[cut:]

    def title(self, text: str) -> None:
        if NOTE.match(text):
            self.levels, self.pinned = [text, None], True
        elif self.pinned:
            self.levels[1] = text
        else:
            self.levels = [text, None]

    def caption(self) -> list[str]:
        """Takes the lines that belong to the table that follows off the preface.

        All centred lines at its end; without any, captions of at most ``MAX_CAPTION`` characters together, or
        one short plain line.  Page chrome among them is dropped.
        """
        lines: list[str] = []
        while self.preface and self.preface[-1].align == "center":
            lines.append(self.preface.pop().text)
        lines = [x for x in lines if not is_chrome(x)]
        if lines:
            return lines[::-1]
        room = MAX_CAPTION
        while self.preface:
            block = self.preface[-1]
            if not is_chrome(block.text):
                need = len(block.text) + 2 * bool(lines)
                fits = is_caption(block) or not lines and len(block.text) <= MAX_SUBSECTION
                if need > room or not fits:
                    break
                room -= need
                lines.append(block.text)
            self.preface.pop()
        return lines[::-1]

    def step(self, block: Block) -> None:
        text = block.text
        if block.kind == "table":
            lines = self.caption()
            self.settle()
            self.flush()
            self.emit(True, "\n\n".join([*lines, text]), beside="\n".join(lines))
            self.after_table, self.footers = True, []
            return
        if head := section_title(text):
            self.settle()
            self.flush()
            self.section, self.levels, self.pinned = head, [None, None], False
        elif self.after_table and is_footer(text) and len(text) + len("\n\n".join(self.footers)) <= MAX_FOOTER:
            self.out[-1][-1] += "\n\n" + text
            self.footers.append(text)
            return
        elif is_subsection(block):
            self.settle()
            self.flush()
            self.title(text)
            self.preface.append(block)
        else:
            self.preface.append(block)
            if sum(len(b.text) for b in self.preface) > PREFACE_WINDOW:
                self.settle(keep=len(self.preface) - 1)
                if sum(map(len, self.prose)) > MAX_TEXT:
                    self.flush()
        self.after_table = False


def chunks_of(html: str | None) -> list[list]:
    """[is_table, section, subsection, subsubsection, text] of every chunk, in document order."""
    chunker = Chunker()
    for block in blocks_of(html):
        chunker.step(block)
    chunker.settle()
    chunker.flush()
    return chunker.out


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``SLICE`` bytes of a text column, one row at least, so that what is made of one stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(batch):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _mapped(pages: DataFrame, keys: list[str], html: str, schema: str, make) -> DataFrame:
    names = [c.split()[0] for c in schema.split(",")]
    kept = StructType([pages.schema[k] for k in keys])
    out = StructType([*kept.fields, *_parse_datatype_string(schema).fields])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(out)
        for batch in (part for whole in batches for part in slices(whole, len(keys))):
            made = [[(i, *row) for i, row in enumerate(make(text))] for text in batch.column(len(keys)).to_pylist()]
            whose = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]), pa.int64())
            rows = [row for m in made for row in m]
            columns = [batch.column(k).take(whose) for k in range(len(keys))] + [pa.array([r[i] for r in rows], shape.field(len(keys) + i).type) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *names])

    return pages.select(*keys, html).mapInArrow(body, out)


def html_blocks(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    return _mapped(pages, keys, html, BLOCKS, lambda text: [(b.kind, b.text, b.align, b.bold) for b in blocks_of(text)])


def filing_chunks(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Chunks of every page; ``keys`` are any columns to carry along, so that no join brings them back."""
    return _mapped(pages, keys, html, CHUNKS, chunks_of)


def chunk_filings(filings: DataFrame) -> DataFrame:
    """``filings(ticker, company_name, fiscal_year, fiscal_quarter, form, html, ...)`` -> chunk rows with ids."""
    meta = [c for c in ("company_name", "filing_date", "report_date", "quarter_period_label", "quarter_months") if c in filings.columns]
    made = filing_chunks(filings, ["ticker", "fiscal_year", "fiscal_quarter", "form", *meta])
    return made.withColumn("fiscal_period", ids.fiscal_period(F.col("form"), F.col("fiscal_quarter"))).select(
        ids.chunk_id(F.col("ticker"), F.col("fiscal_year"), F.col("fiscal_period"), F.col("form"), F.col("pos")).alias("chunk_id"),
        F.upper("ticker").alias("ticker"), *meta, F.col("form").alias("doc_type"), "fiscal_year", "fiscal_period", "is_table", "section", "subsection", "subsubsection", "text",
    )
