"""Questions to paced services as a Spark data source.

asked() writes the distinct questions by service and by range of their hash; each such part is a partition of a Python data
source, read by a task of its own. A service allows one call per pause over all; each of its partitions gets an equal part of that
budget, so that it is kept however many run at once. A task commits its answers in small files as it goes and starts by reading those that are there: one that
is lost or repeated asks again only what it had not committed, and a later run with the same folder only what is new.

Questions are (service, key), answers (service, key, answer, error): answer is what the service's function returned, as JSON; where it
raised, answer is null and error says why, and a later run asks again. Null keys are not asked. Files are read and written through the file systems that pyarrow knows by their URI.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioscan.sources.tables import folder as new_folder

ANSWER = "service string, key string, answer string, error string"
#: Ranges that the questions of a service are dealt to, and the answers of a file.
RANGES, CHUNK = 16, 20
_ANSWERS = pa.schema([("key", pa.string()), ("answer", pa.string()), ("error", pa.string())])


@dataclass(frozen=True)
class Service:
    """A function from a key to anything that JSON can say, and the seconds between two calls."""

    ask: Callable[[str], Any]
    pause: float = 0.0


class Part(InputPartition):
    """The questions of one service in one range; pause is that of the service times its parts."""

    def __init__(self, service: str, number: str, pause: float):
        self.service, self.number, self.pause = service, number, pause


class Reader(DataSourceReader):
    def __init__(self, services: dict[str, Service], questions: str, answers: str, chunk: int = CHUNK):
        self.services, self.questions, self.answers, self.chunk = services, questions, answers, chunk

    def partitions(self) -> list[Part]:
        files, path = pyarrow.fs.FileSystem.from_uri(self.questions)
        parts = []
        for name, service in sorted(self.services.items()):
            folders = files.get_file_info(pyarrow.fs.FileSelector(f"{path}/service={name}", allow_not_found=True))
            numbers = sorted(i.base_name.partition("=")[2] for i in folders if i.type == pyarrow.fs.FileType.Directory)
            parts += [Part(name, n, service.pause * len(numbers)) for n in numbers]
        return parts or [Part("", "", 0.0)]

    def _rows(self, root: str, part: Part) -> Iterator[dict]:
        files, path = pyarrow.fs.FileSystem.from_uri(root)
        for info in files.get_file_info(pyarrow.fs.FileSelector(f"{path}/service={part.service}/range={part.number}", allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with files.open_input_file(info.path) as f:
                    yield from pyarrow.parquet.ParquetFile(f).read().to_pylist()

    def _commit(self, part: Part, rows: list[dict]) -> None:
        files, path = pyarrow.fs.FileSystem.from_uri(self.answers)
        at, name = f"{path}/service={part.service}/range={part.number}", uuid.uuid4().hex
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/{name}.part") as f:
            pyarrow.parquet.write_table(pa.Table.from_pylist(rows, _ANSWERS), f)
        files.move(f"{at}/{name}.part", f"{at}/{name}.parquet")

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.service:
            return
        known = {r["key"]: r["answer"] for r in self._rows(self.answers, partition) if r["error"] is None}
        keys = sorted({r["key"] for r in self._rows(self.questions, partition)})
        yield from ((partition.service, k, known[k], None) for k in keys if k in known)
        new = [k for k in keys if k not in known]
        last = 0.0
        for i in range(0, len(new), self.chunk):
            rows = []
            for key in new[i : i + self.chunk]:
                time.sleep(max(0.0, last + partition.pause - time.time()))
                last = time.time()
                try:
                    rows.append({"key": key, "answer": json.dumps(self.services[partition.service].ask(key)), "error": None})
                except Exception as e:  # any failure of a service is an answer without content
                    rows.append({"key": key, "answer": None, "error": str(e)})
            self._commit(partition, rows)
            yield from ((partition.service, r["key"], r["answer"], r["error"]) for r in rows)


def asked(questions: DataFrame, services: dict[str, Service], folder: str | None = None, ranges: int = RANGES, chunk: int = CHUNK) -> DataFrame:
    """(service, key, answer, error) for each distinct question (service, key). folder: where answers are kept, for all runs that name it; else a new one."""
    spark, name = questions.sparkSession, f"folioscan_{uuid.uuid4().hex}"
    number = F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int")
    distinct = questions.where("key IS NOT NULL").select("service", "key").distinct().withColumn("range", number)
    path = new_folder(spark)
    distinct.repartition("service", "range").write.partitionBy("service", "range").parquet(path)
    answers = folder or new_folder(spark)

    class Answers(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ANSWER

        def reader(self, schema) -> Reader:
            return Reader(services, path, answers, chunk)

    spark.dataSource.register(Answers)
    return spark.read.format(name).load()
