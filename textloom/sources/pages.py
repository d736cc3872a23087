"""A sink of one text file a document, with a metadata table beside them, as a Python data source.

df.write.format("docfiles").option("path", folder).save() for df(side, docid, text, and
columns of metadata). Texts go to folder/<side>/<docid>.txt; what is told about them to
folder/<side>_md/part-*.csv (filename and the other columns, with a header). A task
writes its texts under names of its own and moves each into place whole, so a
task that is repeated writes the same files again; its part of the metadata counts
only if the task is committed, and parts of other attempts are removed then.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """One committed attempt: the name of its parts, and its documents by side."""

    attempt: str
    documents: dict[str, int]


class DocFilesWriter(DataSourceWriter):
    def __init__(self, folder: str, columns: list[str], overwrite: bool):
        self.folder, self.columns, self.overwrite = folder, columns, overwrite
        if missing := {"side", "docid", "text"} - set(columns):
            raise ValueError(f"columns that are missing: {sorted(missing)}")
        self.rest = [c for c in columns if c not in ("side", "docid", "text")]

    def _at(self, path: str = "") -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        return fs, f"{root}/{path}" if path else root

    def write(self, iterator: Iterator[Row]) -> Written:
        attempt, told = uuid.uuid4().hex, {}
        fs, root = self._at()
        for row in iterator:
            side, name = _safe(row["side"]), _safe(row["docid"]) + ".txt"
            if side not in told:
                fs.create_dir(f"{root}/{side}", recursive=True)
                fs.create_dir(f"{root}/{side}_md", recursive=True)
                out = fs.open_output_stream(f"{root}/{side}_md/part-{attempt}.csv")
                told[side] = [out, 0]
                out.write(_line(["filename", *self.rest]))
            made = f"{root}/{side}/.{attempt}"
            with fs.open_output_stream(made) as text:
                text.write((row["text"] or "").encode("utf-8", "surrogatepass"))
            fs.move(made, f"{root}/{side}/{name}")
            told[side][0].write(_line([name, *("" if row[c] is None else str(row[c]) for c in self.rest)]))
            told[side][1] += 1
        for out, _ in told.values():
            out.close()
        return Written(attempt, {side: n for side, (_, n) in told.items()})

    def commit(self, messages: list[Written | None]) -> None:
        self._keep({m.attempt for m in messages if m})

    def abort(self, messages: list[Written | None]) -> None:
        self._keep(set())

    def _keep(self, attempts: set[str]) -> None:
        """Metadata parts, and texts left half written, of other attempts go."""
        fs, root = self._at()
        if fs.get_file_info(root).type == pafs.FileType.NotFound:
            fs.create_dir(root, recursive=True)
        for top in fs.get_file_info(pafs.FileSelector(root)):
            if top.type == pafs.FileType.Directory:
                for info in fs.get_file_info(pafs.FileSelector(top.path)):
                    part = re.fullmatch(r"part-([0-9a-f]{32})\.csv|\.([0-9a-f]{32})", info.base_name)
                    if part and (part[2] or part[1] not in attempts):
                        fs.delete_file(info.path)


def _safe(name) -> str:
    """A file name that stands for one name only: what could be a path is written as %XX."""
    text = re.sub(r"[^\w.\- ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), "" if name is None else str(name))
    return text if text.strip(".") else "%2E" * len(text) or "%00"


def _line(cells: list[str]) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(cells)
    return out.getvalue().encode()


class DocFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docfiles"

    def writer(self, schema, overwrite: bool) -> DocFilesWriter:
        return DocFilesWriter(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format docfiles known to the session."""
    spark.dataSource.register(DocFiles)
