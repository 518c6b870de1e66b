"""A sink that appends each arriving dataset as a generation of its file.

Files lie in a folder that all executors share, one a name. A generation is appended to a copy, which then takes the file's place, so a reader sees the
old file or the new one. A batch that is written again adds nothing: a dataset that is already the newest generation is left out.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..model import document as doc
from ..sources import container as C
from ..sources import profiles

SUFFIX = ".generations"


def append_to(path: str, fmt: C.Format, documents: list[bytes], profile: int = profiles.LOSSLESS) -> int:
    """Appends the documents (debug JSON) in order; returns how many were new."""
    data, added = None, 0
    if os.path.exists(path):
        with open(path, "rb") as file:
            data = file.read()
    for text in documents:
        root = bytes.fromhex(doc.identities([doc.read(text)], "logical", fmt.names)[0])
        if data is None:
            data = C.start_generations(fmt, C.encode(fmt, text, root, profile=profile))
        elif C.parse(fmt, data)["root_id"] != root:
            data = C.append_generation(fmt, data, text, root)
        else:
            continue
        added += 1
    if added:
        unfinished = f"{path}.{os.getpid()}"
        with open(unfinished, "wb") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        os.replace(unfinished, path)
    return added


def append_datasets(datasets: DataFrame, folder: str, fmt: C.Format) -> DataFrame:
    """Appends datasets (name, sequence, document) in order of sequence to the file of their name: name, new generations and the file's length in them."""

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        path = os.path.join(folder, key[0] + SUFFIX)
        new = append_to(path, fmt, [d.encode() for d in rows.sort_values("sequence")["document"]])
        with open(path, "rb") as file:
            length = len(C.generations(fmt, file.read()))
        return pd.DataFrame({"name": [key[0]], "new": [new], "generations": [length]})

    return datasets.select("name", "sequence", "document").groupBy("name").applyInPandas(write, "name string, new long, generations long")


def generation_sink(datasets: DataFrame, folder: str, fmt: C.Format) -> DataStreamWriter:
    """The writer of a stream of datasets; set its checkpoint and trigger and start it."""
    return datasets.writeStream.foreachBatch(lambda batch, _: append_datasets(batch, folder, fmt).agg(F.sum("new")).collect())
