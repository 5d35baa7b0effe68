"""Binary flight logs as a Spark data source: frames of messages whose formats the log itself describes."""

from __future__ import annotations

import math
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# Fixed values of the log format: the mark before each message, the format message's number and length, the codes of field types
# with their struct codes, and the scale of the codes whose numbers are hundredths.
MARK = b"\xa3\x95"
FORMAT_ID, FORMAT_LENGTH = 128, 89
CODES = {
    "b": "b", "B": "B", "h": "h", "H": "H", "i": "i", "I": "I", "f": "f", "d": "d", "n": "4s", "N": "16s", "Z": "64s",
    "c": "h", "C": "H", "e": "i", "E": "I", "L": "i", "M": "B", "q": "q", "Q": "Q",
}
HUNDREDTHS = frozenset("cCeE")

SCHEMA = "path string, offset long, type string, time_us long, numbers map<string,double>, texts map<string,string>"
#: Bytes of a split, of one read, and of the log's beginning in which formats are looked for by every split.
SPLIT, CHUNK, HEAD = 32 << 20, 1 << 20, 1 << 20
#: Messages in a row that a place must begin, so that payload bytes aren't taken for a mark.
CHAIN = 3


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path there, for a local path or a URI that Arrow knows."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Format:
    """A kind of message: name, whole length in bytes, field codes and labels."""

    name: str
    length: int
    codes: str
    labels: tuple[str, ...]

    @property
    def body(self) -> struct.Struct:
        return struct.Struct("<" + "".join(CODES[c] for c in self.codes))

    def fits(self) -> bool:
        return all(c in CODES for c in self.codes) and len(self.codes) == len(self.labels) and self.body.size + 3 == self.length


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def read_format(message: bytes) -> tuple[int, Format]:
    """Number and format of the kind that a format message describes."""
    kind, length, name, codes, labels = struct.unpack("<BB4s16s64s", message[3:FORMAT_LENGTH])
    return kind, Format(_text(name), length, _text(codes), tuple(filter(None, _text(labels).split(","))))


def format_message(kind: int, f: Format) -> bytes:
    return MARK + bytes([FORMAT_ID]) + struct.pack("<BB4s16s64s", kind, f.length, f.name.encode(), f.codes.encode(), ",".join(f.labels).encode())


class Frames:
    """Messages of one file from ``start`` on, each as (offset, number, bytes), read piece by piece."""

    def __init__(self, file, size: int, formats: dict[int, Format]) -> None:
        self.file, self.size, self.formats = file, size, formats
        self.base, self.held = 0, b""

    def have(self, at: int, n: int) -> bytes:
        """The bytes from ``at`` to ``at + n``, fewer at the file's end."""
        if at < self.base or at + n > self.base + len(self.held):
            self.file.seek(at)
            self.base, self.held = at, self.file.read(max(n, min(CHUNK, self.size - at)))
        return self.held[at - self.base : at - self.base + n]

    def length(self, at: int, formats: dict[int, Format]) -> int:
        """Of the message at ``at``; 0 if there is none."""
        head = self.have(at, 3)
        if len(head) < 3 or head[:2] != MARK:
            return 0
        if head[2] == FORMAT_ID:
            n = FORMAT_LENGTH
        else:
            n = formats[head[2]].length if head[2] in formats else 0
        return n if n and at + n <= self.size else 0

    @staticmethod
    def learn(message: bytes, formats: dict[int, Format]) -> None:
        if message[2] == FORMAT_ID:
            kind, f = read_format(message)
            if f.fits():
                formats.setdefault(kind, f)

    def begins(self, at: int) -> bool:
        """Whether ``CHAIN`` messages follow each other from ``at``, or as many as fit before the end."""
        formats = dict(self.formats)
        for _ in range(CHAIN):
            n = self.length(at, formats)
            if not n:
                return False
            self.learn(self.have(at, n), formats)
            at += n
            if at == self.size:
                return True
        return True

    def find(self, at: int) -> int:
        """The first place from ``at`` on where messages begin; the file's size if there is none."""
        while at < self.size:
            here = self.have(at, min(CHUNK, self.size - at))
            k = here.find(MARK)
            if k < 0:
                at += max(1, len(here) - 1)  # the mark may lie across the pieces
                continue
            if self.begins(at + k):
                return at + k
            at += k + 1
        return self.size

    def messages(self, start: int, stop: int) -> Iterator[tuple[int, int, bytes]]:
        """Those that begin in [start, stop). Where the chain breaks it goes on at the next place where messages begin."""
        at = self.find(start)
        while at < stop:
            n = self.length(at, self.formats)
            if not n:
                at = self.find(at + 1)
                continue
            message = self.have(at, n)
            self.learn(message, self.formats)
            yield at, message[2], message
            at += n


@dataclass
class Split(InputPartition):
    path: str
    start: int
    stop: int
    size: int


class FlightLogReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Split]:
        system, at = opened(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.is_file and not posixpath.basename(f.path).startswith(("_", ".")))
        prefix = self.path.split("://", 1)[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
        return [Split(prefix + p, a, min(a + self.split, size), size) for p, size in files for a in range(0, size, self.split)] or [Split("", 0, 0, 0)]

    def read(self, part: Split) -> Iterator[tuple]:
        if not part.size:
            return
        system, at = opened(part.path)
        with system.open_input_file(at) as file:
            formats: dict[int, Format] = {}
            if part.start:
                for _ in Frames(file, part.size, formats).messages(0, min(HEAD, part.start)):
                    pass
            for offset, kind, message in Frames(file, part.size, formats).messages(part.start, part.stop):
                if kind == FORMAT_ID:
                    continue
                f = formats[kind]
                numbers, texts = {}, {}
                for code, label, v in zip(f.codes, f.labels, f.body.unpack(message[3:])):
                    if isinstance(v, bytes):
                        texts[label] = _text(v)
                    else:
                        numbers[label] = v / 100 if code in HUNDREDTHS else float(v)
                time = numbers.get("TimeUS", math.nan)
                yield part.path, offset, f.name, int(time) if abs(time) < 1 << 62 else None, numbers, texts


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class FlightLogWriter(DataSourceWriter):
    """One log for each value of ``log`` in a partition; rows come in the order of the log. Logs appear when all tasks are done, or not at all."""

    def __init__(self, path: str, formats: dict[str, Format], schema: StructType) -> None:
        self.path, self.formats, self.names = path, formats, schema.names
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = opened(self.path)
        folder, done, out, current = posixpath.join(root, self.pending), Written(), None, None
        system.create_dir(folder, recursive=True)
        kinds = {name: k for k, name in enumerate(sorted(self.formats), 1)}
        try:
            for row in rows:
                if out is None or row.log != current:
                    if out:
                        out.close()
                    current = row.log
                    done.files.append((posixpath.join(folder, f"{current}-{uuid.uuid4().hex}"), f"{current}.bin"))
                    out = system.open_output_stream(done.files[-1][0])
                    for name, k in kinds.items():
                        out.write(format_message(k, self.formats[name]))
                f = self.formats[row.type]
                values = [row.numbers.get(x) if CODES[c][-1] != "s" else (row.texts or {}).get(x, "").encode() for c, x in zip(f.codes, f.labels)]
                packed = [v if isinstance(v, bytes) else float(v or 0) if c in "fd" else round((v or 0) * (100 if c in HUNDREDTHS else 1)) for c, v in zip(f.codes, values)]
                out.write(MARK + bytes([kinds[row.type]]) + f.body.pack(*packed))
        finally:
            if out:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        for message in messages:
            for made, name in message.files if message else ():
                system.move(made, posixpath.join(root, name))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = opened(self.path)
        folder = posixpath.join(root, self.pending)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class FlightLog(DataSource):
    """``flightlog``: reads ``SCHEMA``, writes rows ``log, type, numbers, texts`` with the formats of the option ``formats``."""

    @classmethod
    def name(cls) -> str:
        return "flightlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FlightLogReader:
        return FlightLogReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> FlightLogWriter:
        return FlightLogWriter(self.options["path"], formats_of(self.options["formats"]), schema)


def formats_of(text: str) -> dict[str, Format]:
    """Formats from lines ``NAME codes label,label``."""
    out = {}
    for line in filter(None, map(str.strip, text.splitlines())):
        name, codes, labels = line.split()
        size = struct.Struct("<" + "".join(CODES[c] for c in codes)).size
        out[name] = Format(name, size + 3, codes, tuple(labels.split(",")))
        if not out[name].fits() or len(name) > 4 or len(codes) > 16 or len(labels) > 64:
            raise ValueError(f"no format: {line}")
    return out


#: The three kinds that positions need, as :func:`write_flight_log` writes them.
FLIGHT_FORMATS = "GPS QLL TimeUS,Lat,Lng\nATT Qddd TimeUS,Roll,Pitch,Yaw\nBARO Qd TimeUS,Alt"


def read_flight_log(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Messages of a log, or of all logs in a folder, as ``SCHEMA``; ``offset`` orders a log's messages.

    Files are read in splits: each goes to the next place where messages begin, so one long log is many tasks. Formats come from the log's own
    format messages: those in its first megabyte, and those in the split before their use. Damaged bytes are skipped up to the next place where
    several messages follow each other; a message cut by the end is none. Files named ``_`` or ``.`` are not logs; an empty one has no messages.
    """
    spark.dataSource.register(FlightLog)
    return spark.read.format("flightlog").option("split", split).load(path)


def flight_messages(log: DataFrame) -> DataFrame:
    """The three kinds of message with the columns that frames and states are made from; ``flight_id`` is the number in the file's name."""
    of = lambda c: F.try_element_at("numbers", F.lit(c))
    return log.where(F.col("type").isin("GPS", "ATT", "BARO")).select(
        F.regexp_extract("path", r"([0-9]+)[^/]*$", 1).cast("long").alias("flight_id"), (F.col("time_us") / F.lit(1e6)).alias("t"), F.col("offset").alias("seq"), "type",
        of("Lat").cast("long").alias("lat_e7"), of("Lng").cast("long").alias("lon_e7"), of("Roll").alias("roll"), of("Pitch").alias("pitch"), of("Yaw").alias("yaw"), of("Alt").alias("alt"))


def write_flight_log(messages: DataFrame, path: str, time_us: str = "time_us", by: str = "flight_id", order: str = "seq") -> None:
    """One log ``<flight>.bin`` for every flight of ``messages`` (columns as :func:`flight_messages` gives), in the order of ``order``."""
    messages.sparkSession.dataSource.register(FlightLog)
    pairs = {"GPS": (("Lat", "lat_e7"), ("Lng", "lon_e7")), "ATT": (("Roll", "roll"), ("Pitch", "pitch"), ("Yaw", "yaw")), "BARO": (("Alt", "alt"),)}
    numbers = F.lit(None)
    for kind, fields in pairs.items():
        entries = [x for label, c in (("TimeUS", time_us), *fields) for x in (F.lit(label), F.col(c).cast("double"))]
        numbers = F.when(F.col("type") == kind, F.create_map(*entries)).otherwise(numbers)
    rows = messages.select(F.col(by).cast("string").alias("log"), "type", numbers.alias("numbers"), F.lit(None).cast("map<string,string>").alias("texts"), F.col(order).alias("_order"))
    rows.repartition("log").sortWithinPartitions("log", "_order").drop("_order").write.format("flightlog").option("formats", FLIGHT_FORMATS).mode("append").save(path)
