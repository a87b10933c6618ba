"""Annotation folders as a data source: one folder per patient with metadata.json and a pair of .txt and .json per note.

    spark.dataSource.register(AnnotationFolder)
    notes = spark.read.format("annotation_folder").load(path)
    notes.write.format("annotation_folder").mode("append").save(path)

The folder must be mounted under the same path on the driver and all executors. Partitions are planned by patient folder, so no path is
joined and no folder is listed twice.
"""

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from clinspark.schemas import ENTITY, SNAPSHOT_NOTE

# Patient folders that one task reads.
FOLDERS = 200
RECORD = "record.json"
METADATA = "metadata.json"


def local_path(path: str) -> str:
    for scheme in ("file://", "file:"):
        if path.startswith(scheme):
            return path.removeprefix(scheme)
    if "://" in path:
        raise ValueError(f"annotation folders must be mounted, {path} is not a path")
    return path


@dataclass
class Folders(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    notes: int
    patients: list[str]


def _place(path: str, text: str) -> None:
    """Writes a file as a whole: a repeated task replaces it by the same content."""
    with open(f"{path}.{os.getpid()}.part", "w", encoding="utf-8", newline="") as file:
        file.write(text)
    os.replace(file.name, path)


def _json(path: str) -> dict:
    with open(path, encoding="utf-8", newline="") as file:
        try:
            return json.load(file)
        except ValueError as error:
            raise ValueError(f"{path} cannot be read: {error}") from error


class FolderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = local_path(path)

    def partitions(self) -> list[InputPartition]:
        found = sorted(e.path for e in os.scandir(self.path) if e.is_dir())
        return [Folders(found[at : at + FOLDERS]) for at in range(0, len(found), FOLDERS)]

    def read(self, partition: InputPartition) -> Iterator[Row]:
        for folder in partition.paths if partition else []:
            patient = f"{folder}/{METADATA}"
            person = _json(patient).get("person_id") if os.path.exists(patient) else None
            for name in sorted(os.listdir(folder)):
                stem, kind = os.path.splitext(name)
                if kind != ".json" or name == METADATA or not os.path.exists(f"{folder}/{stem}.txt"):
                    continue
                note = _json(f"{folder}/{name}")
                with open(f"{folder}/{stem}.txt", encoding="utf-8", newline="") as file:
                    note["note_text"] = file.read()
                note.setdefault("person_id", person)
                entities = [Row(*[e.get(f) for f in ENTITY.names]) for e in note.get("entities") or []]
                text = {f: None if note.get(f) is None else str(note[f]) for f in ("note_id", "person_id", "note_date", "note_text")}
                yield Row(*[{**note, **text, "entities": entities}.get(f) for f in SNAPSHOT_NOTE.names])


class FolderWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = local_path(path), schema.names
        missing = {"note_id", "person_id", "note_text"} - set(self.names)
        if missing:
            raise ValueError(f"annotation folders need the columns {sorted(missing)}")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        notes, patients = 0, set()
        for row in iterator:
            note = row.asDict(recursive=True)
            folder = f"{self.path}/{note['person_id']}"
            if str(note["person_id"]) not in patients:
                os.makedirs(folder, exist_ok=True)
                _place(f"{folder}/{METADATA}", json.dumps({"person_id": note["person_id"]}))
            _place(f"{folder}/{note['note_id']}.txt", note.pop("note_text") or "")
            _place(f"{folder}/{note['note_id']}.json", json.dumps(note, ensure_ascii=False, default=str))
            notes += 1
            patients.add(str(note["person_id"]))
        return Written(notes, sorted(patients))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """One record beside the folders, when all tasks are done."""
        done = [m for m in messages if m is not None]
        os.makedirs(self.path, exist_ok=True)
        _place(f"{self.path}/{RECORD}", json.dumps({"num_docs": sum(m.notes for m in done), "num_patients": len({p for m in done for p in m.patients})}))


class AnnotationFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "annotation_folder"

    def schema(self) -> StructType:
        return SNAPSHOT_NOTE

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("annotation folders are added to, not overwritten")
        return FolderWriter(self.options["path"], schema)
