"""Text of attached documents, from their bytes, with a status for everything that cannot be read."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES, MAX_PARTS, MAX_RATIO = 5_000_000, 200, 100


def extract(content: bytes | None, kind: str) -> tuple[str, str]:
    """(status, whole text) of a txt or hwpx document; archives that expand too far or declare entities are refused."""
    content = content or b""
    if len(content) > MAX_BYTES:
        return "too_large", ""
    if kind == "txt":
        for encoding in ("utf-8-sig", "cp949"):
            try:
                text = content.decode(encoding)
            except UnicodeDecodeError:
                continue
            return ("ok", text) if text.strip() else ("no_text", "")
        return "parse_error", ""
    if kind != "hwpx":
        return "unsupported", ""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        parts = [i for i in archive.infolist() if re.fullmatch(r"Contents/section\d+\.xml", i.filename)]
        if any(i.flag_bits & 1 for i in archive.infolist()):
            return "encrypted", ""
        if len(parts) > MAX_PARTS or sum(i.file_size for i in archive.infolist()) > MAX_RATIO * max(1, len(content)):
            return "unsafe_document", ""
        markup = "\n".join(archive.read(i).decode("utf-8") for i in sorted(parts, key=lambda i: i.filename))
    except (zipfile.BadZipFile, UnicodeDecodeError, NotImplementedError):
        return "parse_error", ""
    if "<!DOCTYPE" in markup or "<!ENTITY" in markup:
        return "unsafe_document", ""
    text = "\n".join(line for line in (" ".join(x.split()) for x in re.sub(r"<[^>]*>", "\n", markup).split("\n")) if line)
    return ("ok", text) if text else ("no_text", "")


def attachment_text(content: Column, kind: Column) -> Column:
    @F.pandas_udf("status string, text string")
    def read(contents: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(c, k) for c, k in zip(contents, kinds)], columns=["status", "text"])

    return read(content, kind)
