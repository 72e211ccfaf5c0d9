"""Lines of detection and test logs as typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# What the lines of a detection log look like.
CHECKING = r"Checking page (\d+)"
END_EVENT = r"p(\d+): end=True, signal=(signature_block|table_end), signal_on_page=(\d+)"
DOC_START = r"doc starts at page (\d+)"
DOC_START_SIGNAL = r"doc starts at page (\d+) \(conf=\d+%, signal=(\w+)\)"
START_DETECT = r"\[START-DETECT\] p(\d+)"
GATE = r"\[TITLE-GATE\] p(\d+): title=(.*) identifier=(.*) -> grounded=(\d)/2"
CAPPED = r"\[TITLE-GATE\] p(\d+) one-of-two"
SUPPRESSED = r"\[TITLE-GATE\] titled_id_header at p(\d+) SUPPRESSED"
RELOCATED = r"\[TITLE-GATE-RELOC\] grounded title on p(\d+)"
RELOCATED_TITLE = r"\[TITLE-GATE-RELOC\] grounded title on p(\d+) \(title=(.*) id=(.*), grounded=(\d)/2\)"
REQUERY = r"\[WINDOW-REQUERY\]"
FILE_MARKER = r"^(Image_(?U:\w)+\.pdf)$"
PREDICTIONS = r"pred=\[([^\]]*)\]"
# What the lines of a test run's log look like.
RUN_FILE = r"File\s+:\s+\S+/(Image_\S+\.pdf)"
RUN_PAGES = r"end-of-document detection \((\d+) pages\)"
RUN_BOUNDARIES = r"Boundaries — TP=\d+ FP=\d+ FN=\d+.*F1=(\d+)%"
RUN_PRECISION, RUN_RECALL, RUN_F1 = r"Precision\s*:\s*([\d.]+)%", r"Recall\s*:\s*([\d.]+)%", r"F1 score\s*:\s*([\d.]+)%"
RUN_HEADING = r"^(?:\d{2}:\d{2}:\d{2})?\s*(BOUNDARY DETECTION|PAGE ROTATION)\s*$"
RUN_ROTATIONS = r"Rotations\s+— TP=(\d+) FP=(\d+) FN=(\d+).*F1=(\d+)%"


def _part(line: Column, pattern: str, k: int) -> Column:
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, k))


def _number(line: Column, pattern: str, k: int = 1) -> Column:
    return _part(line, pattern, k).try_cast("int")


def bare(line: Column) -> Column:
    return F.regexp_replace(line, "^(?U:\\s)+|(?U:\\s)+$", "")


def page_list(text: Column) -> Column:
    """``1, 4, 7`` as an array; blank entries are none."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def parse_detection(log: DataFrame) -> DataFrame:
    """Adds to (source, line_no, line) what a line says, null where it says nothing of the kind."""
    line = F.col("line")
    gate = line.rlike(GATE)
    moved = ~gate & line.rlike(RELOCATED_TITLE)
    either = lambda k: F.when(gate, F.regexp_extract(line, GATE, k)).when(moved, F.regexp_extract(line, RELOCATED_TITLE, k))
    return log.select(
        "*",
        _number(line, CHECKING).alias("checking"),
        _number(line, DOC_START).alias("doc_start"),
        _part(line, DOC_START_SIGNAL, 2).alias("doc_start_signal"),
        _number(line, START_DETECT).alias("start_detect"),
        _number(line, END_EVENT, 1).alias("end_page"),
        _part(line, END_EVENT, 2).alias("end_signal"),
        _number(line, END_EVENT, 3).alias("end_signal_page"),
        F.when(gate, "gate").when(moved, "reloc").alias("title_event"),
        either(1).try_cast("int").alias("title_page"),
        T.unquote(bare(either(2))).alias("title"),
        T.unquote(bare(either(3))).alias("identifier"),
        either(4).try_cast("int").alias("grounded"),
        _number(line, CAPPED).alias("capped"),
        _number(line, SUPPRESSED).alias("suppressed"),
        _number(line, RELOCATED).alias("reloc"),
        line.rlike(REQUERY).alias("requery"),
        _part(bare(line), FILE_MARKER, 1).alias("file_marker"),
        F.when(bare(line).endswith(".pdf"), bare(line)).alias("any_pdf"),
        F.when(line.rlike(PREDICTIONS), page_list(F.regexp_extract(line, PREDICTIONS, 1))).alias("pred"),
    )


def parse_overall(log: DataFrame) -> DataFrame:
    """Adds what a line says of a run's overall figures: heading (rotation or boundaries), precision, recall, f1."""
    line = F.col("line")
    heading = F.regexp_extract(line, RUN_HEADING, 1)
    of = lambda p: F.when(line.rlike(p), F.regexp_extract(line, p, 1).try_cast("double"))
    kind = F.when(heading == "PAGE ROTATION", "rotation").when(heading != "", "boundaries")
    return log.select("*", kind.alias("heading"), of(RUN_PRECISION).alias("precision"), of(RUN_RECALL).alias("recall"), of(RUN_F1).alias("f1"))


def parse_run(log: DataFrame) -> DataFrame:
    """Adds what a line of a test run's log says: file, clock, pages, boundary F1, rotation counts and F1."""
    line = F.col("line")
    file = line.rlike(RUN_FILE)
    pages = ~file & line.rlike(RUN_PAGES)
    bounds = ~file & ~pages & line.rlike(RUN_BOUNDARIES)
    turned = ~file & ~pages & line.rlike(RUN_ROTATIONS)
    n = lambda when, pattern, k: F.when(when, F.regexp_extract(line, pattern, k).try_cast("int"))
    return log.select(
        "*",
        F.when(file, F.regexp_extract(line, RUN_FILE, 1)).alias("run_file"),
        T.clock_seconds(line).alias("clock"),
        n(pages, RUN_PAGES, 1).alias("pages"),
        n(bounds, RUN_BOUNDARIES, 1).alias("boundary_f1"),
        *[n(turned, RUN_ROTATIONS, k).alias(f"rot_{c}") for k, c in enumerate(("tp", "fp", "fn", "f1"), 1)],
    )
