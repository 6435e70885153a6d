"""Java archives as tables: manifests, class names and class-file headers from binary rows."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_of(data: str) -> dict[str, str]:
    """Main attributes; a line that starts with a space goes on with the one before."""
    out: dict[str, str] = {}
    for line in data.replace("\r\n", "\n ").replace("\n  ", "").replace("\n ", "\n").split("\n"):
        if not line.strip():
            break
        key, _, value = line.partition(":")
        out[key.strip()] = value.strip()
    return out


def class_header(data: bytes) -> dict:
    """Name, super class and methods of a class file."""
    magic, _, _, count = struct.unpack_from(">IHHH", data)
    if magic != 0xCAFEBABE:
        raise ValueError("not a class file")
    pool: list = [None] * count
    at, i = 10, 1
    while i < count:
        tag = data[at]
        if tag == 1:
            size = struct.unpack_from(">H", data, at + 1)[0]
            pool[i] = data[at + 3 : at + 3 + size].decode("utf-8", "replace")
            at += 3 + size
        else:
            if tag in (7, 8, 16, 19, 20):
                pool[i] = struct.unpack_from(">H", data, at + 1)[0]
            # Bytes of each kind of constant, its tag included.
            at += {3: 5, 4: 5, 5: 9, 6: 9, 7: 3, 8: 3, 9: 5, 10: 5, 11: 5, 12: 5, 15: 4, 16: 3, 17: 5, 18: 5, 19: 3, 20: 3}[tag]
            i += tag in (5, 6)
        i += 1
    _, own, parent, n = struct.unpack_from(">HHHH", data, at)
    at += 8 + 2 * n
    methods: list[str] = []
    for members in (None, methods):
        n = struct.unpack_from(">H", data, at)[0]
        at += 2
        for _ in range(n):
            _, name, kind, attributes = struct.unpack_from(">HHHH", data, at)
            at += 8
            for _ in range(attributes):
                at += 6 + struct.unpack_from(">I", data, at + 2)[0]
            if members is not None:
                members.append(f"{pool[name]}{pool[kind]}")
    return {"class_name": pool[pool[own]], "super_name": pool[pool[parent]] if parent else None, "methods": methods}


def inspect_jars(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, manifest map, sorted class names, error of each archive (spark.read.format('binaryFile'))."""

    @F.pandas_udf("manifest map<string,string>, classes array<string>, error string")
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for data in contents:
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    names = z.namelist()
                    found = manifest_of(z.read("META-INF/MANIFEST.MF").decode("utf-8")) if "META-INF/MANIFEST.MF" in names else {}
                    rows.append((found, sorted(n[:-6].replace("/", ".") for n in names if n.endswith(".class")), None))
            except (zipfile.BadZipFile, UnicodeDecodeError) as e:
                rows.append((None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["manifest", "classes", "error"])

    return files.select(id_col, run(content_col).alias("_j")).select(id_col, "_j.*")
