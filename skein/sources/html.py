"""HTML-like documents as sections."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCKS = frozenset("address article aside blockquote body div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Node:
    __slots__ = ("children", "tag")

    def __init__(self, tag: str):
        self.tag, self.children = tag, []

    def text(self) -> str:
        """Text below, scripts and styles left out, without recursion: markup may nest deeply."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style") or x is self:
                stack.extend(reversed(x.children))
        return "".join(out)

    def walk(self) -> Iterator[_Node]:
        stack = [c for c in reversed(self.children) if not isinstance(c, str)]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(c for c in reversed(x.children) if not isinstance(c, str))


class _Builder(HTMLParser):
    def __init__(self, close_p: bool):
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open, self.close_p = [self.root], close_p

    def handle_starttag(self, tag, attrs):
        if self.close_p and tag in _BLOCKS:
            self._end("p")
        if self.close_p and tag == "li" and (at := [n.tag for n in self.open]) and "li" in at and at[::-1].index("li") < (at[::-1].index("ul") if "ul" in at else len(at)):
            self._end("li")
        node = _Node(tag)
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag))

    def handle_endtag(self, tag):
        self._end(tag)

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def _end(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return


def _tree(html: str, close_p: bool) -> _Node:
    builder = _Builder(close_p)
    builder.feed(html)
    builder.close()
    return builder.root


def header_sections(html: str, levels: Sequence[str] = ("h1",), close_p: bool = True) -> list[tuple[str, str]]:
    """(header path, text) of sections: headers open them, p, li and tr add lines; blank ones are left out."""
    out, path, lines = [], [], []

    def flush() -> None:
        if text := "".join(lines).strip():
            out.append(("/".join(path), text))
            lines.clear()

    for node in _tree(html, close_p).walk():
        if node.tag in levels:
            flush()
            del path[int(node.tag[1]) - 1 :]
            path.append(node.text().strip())
        elif node.tag == "p":
            lines.append(node.text() + "\n")
        elif node.tag == "li":
            lines.append("- " + node.text() + "\n")
        elif node.tag == "tr" and (cells := [n.text() for n in node.walk() if n.tag == "td"]):
            lines.append(" | ".join(cells) + "\n")
    flush()
    return out


def sibling_sections(html: str, tags: Sequence[str] = ("h1", "h2"), close_p: bool = True) -> list[tuple[str, str]]:
    """(tag, text) of each occurrence of each tag: it and its siblings up to the next of the tags, a line each."""
    out = []
    root = _tree(html, close_p)
    parents = [root, *root.walk()]
    for tag in tags:
        for parent in parents:
            for k, child in enumerate(parent.children):
                if not isinstance(child, str) and child.tag == tag:
                    text = child.text() + "\n"
                    for other in parent.children[k + 1 :]:
                        if not isinstance(other, str) and other.tag in tags:
                            break
                        text += (other if isinstance(other, str) else other.text()) + "\n"
                    out.append((tag, text))
    return out


def sections(docs: DataFrame, key: str, html: str, mode: str = "header", **how) -> DataFrame:
    """(key, section_idx, header_path, text) of documents, in order. mode: "header" or "sibling"."""
    split = {"header": header_sections, "sibling": sibling_sections}[mode]

    def run(batches):
        for b in batches:
            rows = [(k, i, path, text) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, (path, text) in enumerate(split(h or "", **how))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())], names=["key", "section_idx", "header_path", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, html).mapInArrow(run, f"key {kind}, section_idx int, header_path string, text string").withColumnRenamed("key", key)


def unwrap_links(html: Column) -> Column:
    """Anchor tags out, their text kept."""
    return F.regexp_replace(html, r"(?i)</?a(\s[^>]*)?>", "")


def read_html(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(path, html) of a folder's files and those below it; empty files have no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("html"))


def render_metadata(metadata: Column, text: Column, excluded: Sequence[str] = ()) -> Column:
    """`key: value` lines of a map, without excluded keys, then the text."""
    kept = F.map_filter(metadata, lambda k, v: ~k.isin(*excluded)) if excluded else metadata
    lines = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return F.concat_ws("\n\n", F.array_join(lines, "\n"), text)
