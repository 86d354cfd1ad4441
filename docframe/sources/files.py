"""Word-processor files as tables: a binary scan, decoded by Arrow-batched functions into rows with explicit ordinals.

Each function takes a DataFrame with path and content (as the binaryFile source gives it). A file that can't be decoded
gives a row with error_class and error_message, never a failed job.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docframe.cluster import ship, spread
from docframe.decode import archive, blocks, blocktree, container, kinds, properties
from docframe.decode.errors import DecodeError, TooLarge, Unsupported
from docframe.limits import Limits

ENTRIES = "path string, entry_no int, entry_path string, name string, kind string, size long, state long, created string, modified string, error_class string, error_message string"
PARAGRAPHS = "path string, sheet_no int, para_no int, text string, page_break_before boolean, error_class string, error_message string"
TOKENS = "path string, sheet_no int, piece_no int, token_no int, kind string, unit_start int, code int, text string, words array<int>, error_class string, error_message string"
SPANS = "path string, sheet_no int, piece_no int, unit_start int, unit_len int, props map<int,long>, error_class string, error_message string"
BLOCKS = "path string, sheet_no int, block_no int, row_no int, cell_no int, para_no int, cell_left int, cell_right int, ruled boolean, text string, runs array<struct<text: string, reading: string, bold: boolean>>, align string, indent array<int>, feed array<int>, page_break_before boolean, error_class string, error_message string"
SUMMARY = "path string, " + ", ".join(f"{n} {'int' if n in ('pages', 'chars') else 'string'}" for n in properties.NAMES.values()) + ", error_class string, error_message string"


def scan(spark: SparkSession, folder: str, pattern: str = "*", max_bytes: int = Limits.max_bytes) -> DataFrame:
    """path, length and content of the files; those above max_bytes have null content, which isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    large = files.where(f"length > {max_bytes}").select("path", "length", F.lit(None).cast("binary").alias("content"))
    return files.where(f"length <= {max_bytes}").select("path", "length", "content").unionByName(large)


def _decoded(files: DataFrame, schema: str, decode) -> DataFrame:
    """One call of decode(bytes) -> list of dicts by file; whatever a file raises becomes its error row."""
    ship(files.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)
    names = arrow.names

    def rows_of(content):
        try:
            if content is None:
                raise TooLarge("the file is above the limit and was not read")
            return decode(content)
        except DecodeError as e:
            return [{"error_class": type(e).__name__, "error_message": str(e)}]
        except Exception as e:  # noqa: BLE001  a hostile file must not end the job
            return [{"error_class": "Corrupt", "error_message": f"{type(e).__name__}: {e}"}]

    def run(batches):
        held = []
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held += [{n: r.get(n) for n in names} | {"path": path} for r in rows_of(content.as_py())]
                while len(held) >= 2_000:
                    yield pa.RecordBatch.from_pylist(held[:2_000], schema=arrow)
                    held = held[2_000:]
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def _document(data: bytes, limits: Limits) -> container.Container:
    if len(data) > limits.max_bytes:
        raise TooLarge(f"{len(data)} bytes")
    c = container.open_container(data)
    if c.find("/DocumentText") is None and (packed := c.find("/JSCompDocument")):
        inner = archive.first_member(c.read(packed), limits.max_bytes)
        if inner is None:
            raise Unsupported("a compressed document without a member")
        c = container.open_container(inner)
    return c


def _sheets(data: bytes, limits: Limits):
    """(sheet_no, pieces or a warning) of the main text and of each further sheet, in the order of their paths.

    Sheets beyond a limit are left out with a warning, a damaged one as well; the main text must be there.
    """
    c = _document(data, limits)
    found = sorted((e for e in c.entries if e.kind == "stream" and e.name == "DocumentText"), key=lambda e: (e.path != "/DocumentText", e.path))
    if not found:
        raise Unsupported("no text stream")
    left = limits.max_text_units
    for no, entry in enumerate(found[: limits.max_sheets]):
        try:
            pieces = blocks.text_pieces(c.read(entry))
        except DecodeError as e:
            if no == 0:
                raise
            yield no, f"sheet {no + 1}: {e}"
            continue
        left -= sum(len(u) // 2 for u, _ in pieces)
        if left < 0:
            if no == 0:
                raise TooLarge("the text is too long")
            yield no, f"sheet {no + 1} and those after it are beyond the limit of {limits.max_text_units} units"
            return
        yield no, [(struct.unpack(f">{len(u) // 2}H", u), s) for u, s in pieces]
    if len(found) > limits.max_sheets:
        yield limits.max_sheets, f"{len(found) - limits.max_sheets} sheets beyond the limit of {limits.max_sheets}"


def _by_sheet(data: bytes, limits: Limits, rows) -> list[dict]:
    """rows(pieces) of each sheet with its number; a warning is a row of error class Warning."""
    out = []
    for no, pieces in _sheets(data, limits):
        if isinstance(pieces, str):
            out.append({"sheet_no": no, "error_class": "Warning", "error_message": pieces})
        else:
            out += [{"sheet_no": no, **r} for r in rows(pieces)]
    return out


def entries(files: DataFrame) -> DataFrame:
    """The container's entries; entry 0 is the root."""

    def decode(data):
        return [{"entry_no": k, "entry_path": e.path, "name": e.name, "kind": e.kind, "size": e.size, "state": e.state, "created": properties.file_time(e.created), "modified": properties.file_time(e.modified)} for k, e in enumerate(container.open_container(data).entries)]

    return _decoded(files, ENTRIES, decode)


def paragraphs(files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008  frozen
    def rows(pieces):
        return ({"para_no": k, "text": t, "page_break_before": b} for k, (t, b) in enumerate(blocks.paragraphs([w for u, _ in pieces for w in u])))

    return _decoded(files, PARAGRAPHS, lambda data: _by_sheet(data, limits, rows))


def tokens(files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008  frozen
    def rows(pieces):
        return ({"piece_no": p, "token_no": k, "kind": t.kind, "unit_start": t.start, "code": t.code, "text": t.text, "words": list(t.words)} for p, (units, _) in enumerate(pieces) for k, t in enumerate(blocks.tokens(units)))

    return _decoded(files, TOKENS, lambda data: _by_sheet(data, limits, rows))


def style_spans(files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008  frozen
    def rows(pieces):
        return ({"piece_no": p, "unit_start": a, "unit_len": n, "props": list(props.items())} for p, (units, style) in enumerate(pieces) for a, n, props in blocks.style_spans(style, len(units), limits.max_style_entries))

    return _decoded(files, SPANS, lambda data: _by_sheet(data, limits, rows))


def tree(files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008  frozen
    """Paragraphs outside and inside of tables, with their runs; a cell without paragraphs has one row without para_no."""

    def rows(pieces):
        units, spans = [], []
        for u, style in pieces:
            spans += [(len(units) + a, n, props) for a, n, props in blocks.style_spans(style, len(u), limits.max_style_entries)]
            units += u
        return blocktree.tree(units, spans)

    return _decoded(files, BLOCKS, lambda data: _by_sheet(data, limits, rows))


def summaries(files: DataFrame) -> DataFrame:
    def decode(data):
        c = container.open_container(data)
        e = next((e for e in c.entries if e.name.endswith("SummaryInformation") and "Document" not in e.name), None)
        return [properties.summary(c.read(e)) if e else {}]

    return _decoded(files, SUMMARY, decode)


def file_kinds(files: DataFrame) -> DataFrame:
    return _decoded(files, "path string, kind string, error_class string, error_message string", lambda data: [{"kind": kinds.file_kind(data)}])


def containers(docs: DataFrame) -> DataFrame:
    """path, content: each text of docs (doc_id, text) as a file with one sheet; the sink side of this module."""
    style = blocks.style_bytes([("keep", 3), ("set", [(20, 0x80000000)])])
    return written(docs.select(F.concat(F.lit("/"), "doc_id", F.lit(".jtd")).alias("path"), "text"), lambda row: blocks.text_store(row["text"] or "", style))


def written(rows: DataFrame, store) -> DataFrame:
    """path, content: a container for each row (path, ...) whose text stream is store(row)."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                content = [container.write_container({"/DocumentText": store(r)}) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary())], names=["path", "content"])

    return spread(rows).mapInArrow(run, "path string, content binary")
