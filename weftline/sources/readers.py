"""Sources: tables, texts, archives and parsers. Files are found and opened by Spark's readers, so any store it reads will do."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import tarfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a parser hands on at a time.
ROWS = 1000
FORMATS = {".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet", ".orc": "orc", ".txt": "text"}


def load_dataframe(spark: SparkSession, path: str | Sequence[str], format: str | None = None, columns: Sequence[str] | None = None, dtype: dict[str, str] | None = None, parse_dates: dict[str, str] | None = None, query: str | None = None, rename: dict[str, str] | None = None, constants: dict | None = None, **options) -> DataFrame:
    """Read files by suffix or format; project, cast, rename, add constants, filter. Selection comes first, so the scan reads those columns only."""
    first = path if isinstance(path, str) else path[0]
    kind = format or next((f for s, f in FORMATS.items() if first.removesuffix(".gz").endswith(s)), "parquet")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("sep", "\t" if ".tsv" in first else ",")
    df = reader.options(**options).load(path if isinstance(path, str) else list(path))
    df = df.select(*columns) if columns else df
    df = df.withColumns({c: F.col(c).cast(t) for c, t in (dtype or {}).items()})
    df = df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string"), F.lit(f)) for c, f in (parse_dates or {}).items()})
    df = df.withColumnsRenamed(rename or {}).withColumns({k: F.lit(v) for k, v in (constants or {}).items()})
    return df.where(query) if query else df


PACKED = (".tar", ".tar.gz", ".tgz", ".tar.xz", ".tar.bz2", ".zip", ".gz", ".bz2", ".xz", ".zst")


def _unpacked(name: str, data: bytes) -> Iterator[tuple[str, bytes | io.BufferedReader]]:
    """(member, content) of an archive or a compressed file, by its suffix; nested compression is undone too. A Zstandard file is a stream, read as it is parsed."""
    if name.endswith((".tar", ".tar.gz", ".tgz", ".tar.xz", ".tar.bz2")):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    yield from _unpacked(m.name, t.extractfile(m).read())
    elif name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield from _unpacked(m.filename, z.read(m))
    elif name.endswith((".gz", ".bz2", ".xz")):
        suffix = name[name.rindex(".") :]
        yield from _unpacked(name.removesuffix(suffix), {".gz": gzip, ".bz2": bz2, ".xz": lzma}[suffix].decompress(data))
    elif name.endswith(".zst"):
        import zstandard

        inner = name.removesuffix(".zst")
        stream = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
        if inner.endswith(PACKED):
            yield from _unpacked(inner, stream.read())
        else:
            yield inner, io.BufferedReader(stream, 1 << 20)
    else:
        yield name, data


def load_archives(spark: SparkSession, path: str, parser: Callable[[str, bytes], Iterator[dict]] | str = "plaintext", schema: str = "text string", suffix: str = "", **options) -> DataFrame:
    """(path, member, ...parsed columns) of every member of archives and compressed files, a file to a task at a time; suffix is taken as the end of names that do not tell."""
    parse = parser if callable(parser) else PARSERS[parser]
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                for member, content in _unpacked(file + suffix, data):
                    if isinstance(content, io.BufferedReader) and parse not in STREAMED:
                        content = content.read()
                    parsed = iter(parse(member, content, **options))
                    while rows := list(islice(parsed, ROWS)):  # a member's rows never stand all in memory
                        yield pd.DataFrame({"path": [file] * len(rows), "member": [member] * len(rows)} | {n: [r.get(n) for r in rows] for n in names})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, member string, {schema}")


def _stream(data: bytes | io.BufferedReader) -> io.BufferedReader | io.BytesIO:
    return io.BytesIO(data) if isinstance(data, (bytes, bytearray, memoryview)) else data


def _plain(name: str, data: bytes, encoding: str = "utf-8") -> Iterator[dict]:
    yield {"text": data.decode(encoding, "replace")}


def _lines(name: str, data: bytes, encoding: str = "utf-8") -> Iterator[dict]:
    for i, line in enumerate(data.decode(encoding, "replace").splitlines()):
        yield {"lineno": i, "text": line}


def _jsonlines(name: str, data: bytes, field: str = "text", separator: str = "\n\n") -> Iterator[dict]:
    """A document a line; a list of texts is joined; bad lines are skipped."""
    for line in (x for part in _stream(data) for x in part.splitlines()):
        try:
            row = json.loads(line)
        except ValueError:
            continue
        text = row.get(field) if isinstance(row, dict) else row
        yield {"text": separator.join(map(str, text)) if isinstance(text, list) else text, "meta": json.dumps(row.get("meta")) if isinstance(row, dict) else None}


def _json(name: str, data: bytes, field: str | None = None, text: str = "text", separator: str = "\n") -> Iterator[dict]:
    """Documents of one JSON value: the list at a dotted path, or the value itself."""
    value = json.loads(data)
    for part in field.split(".") if field else ():
        value = value.get(part, []) if isinstance(value, dict) else []
    for row in value if isinstance(value, list) else [value]:
        found = row.get(text) if isinstance(row, dict) else row
        yield {"text": separator.join(s for x in found if (s := str(x).strip())) if isinstance(found, list) else found}


def _dat(name: str, data: bytes) -> Iterator[dict]:
    """Records with their length in bytes before them, 16 digits."""
    stream = _stream(data)
    while head := stream.read(16):
        yield {"text": stream.read(int(head)).decode()}


def _mail(name: str, data: bytes) -> Iterator[dict]:
    import email
    import email.policy

    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    yield {"subject": m["subject"], "date": m["date"], "sender": m["from"], "text": body.get_content() if body else None}


def html_text(data: str) -> str:
    """Visible text of a page, blocks on lines of their own."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")
            if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "title"):
                self.out.append("\n")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style") and self.hidden > 0
            if tag in ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "title"):
                self.out.append("\n")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    r = Reader()
    r.feed(data or "")
    r.close()
    lines = (" ".join(x.split()) for x in "".join(r.out).split("\n"))
    return "\n".join(x for x in lines if x)


def _html(name: str, data: bytes, encoding: str = "utf-8") -> Iterator[dict]:
    yield {"text": html_text(data.decode(encoding, "replace"))}


def _redif(name: str, data: bytes) -> Iterator[dict]:
    """ReDIF templates: `Key: value` lines, values go on over lines that start with white space, a Template-Type line begins the next; # starts a comment."""
    for encoding in ("utf-8", "cp1252"):
        try:
            text = data.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    else:
        text = data.decode("latin-1")
    record: dict[str, list[str]] = {}
    key = None
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.startswith("#") or not line.strip():
            continue
        head, colon, value = line.partition(":")
        if colon and not line[0].isspace() and " " not in head.strip():
            key = head.strip().lower()
            if key == "template-type" and record:
                yield {"text": json.dumps(record)}
                record = {}
            record.setdefault(key, []).append(value.strip())
        elif key:
            record[key][-1] += " " + line.strip()
    if record:
        yield {"text": json.dumps(record)}


#: Parsers by name: (member name, bytes, options) to rows.
PARSERS = {"plaintext": _plain, "plaintext_split": _lines, "jsonlines": _jsonlines, "json": _json, "dat": _dat, "email": _mail, "html": _html, "redif": _redif}
#: Parsers that read streams as well as bytes.
STREAMED = (_jsonlines, _dat)


def html_column(c: Column) -> Column:
    """Visible text of a column of pages, in Arrow batches."""

    @F.pandas_udf("string")
    def apply(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else html_text(p))

    return apply(c)


def json_document(c: Column, items: dict[str, str], separator: str = "\n") -> list[Column]:
    """Columns out of JSON text by path; a list of strings is trimmed, emptied of blanks and joined."""
    out = []
    for name, path in items.items():
        value = F.get_json_object(c, path if path.startswith("$") else f"$.{path}")
        listed = F.from_json(value, "array<string>")
        joined = F.array_join(F.filter(F.transform(listed, F.trim), lambda x: x != ""), separator)
        out.append(F.when(value.startswith("["), joined).otherwise(value).alias(name))
    return out


def load_wordlist(spark: SparkSession, path: str, delimiter: str | None = None, lowercase: bool = False, max_ngram: int | None = None) -> DataFrame:
    """(word): the first field of each line, comments (#) and blanks left out, once each; tags after a delimiter cut off."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    word = F.element_at(F.split(line, r"\s+"), 1)
    word = F.element_at(F.split(word, r"\Q" + delimiter + r"\E"), 1) if delimiter else word
    df = spark.read.text(path).where(line != "").select((F.lower(word) if lowercase else word).alias("word"))
    return (df.where(F.size(F.split("word", ";")) <= max_ngram) if max_ngram else df).distinct()


def plaintext(df: DataFrame, content: str = "value", meta_lines: int = 0, by_line: bool = False) -> DataFrame:
    """Texts whole (their first meta_lines lines beside them), or a row for each line with its number."""
    lines = F.split(content, r"\r?\n", -1)
    rest = [c for c in df.columns if c != content]
    if by_line:
        return df.select(*rest, F.posexplode(lines).alias("lineno", "text"))
    body = F.array_join(F.slice(lines, F.lit(meta_lines + 1), F.greatest(F.size(lines) - meta_lines, F.lit(0))), "\n")
    return df.select(*rest, F.slice(lines, 1, meta_lines).alias("meta"), body.alias("text")) if meta_lines else df.select(*rest, F.col(content).alias("text"))


def annotations(df: DataFrame, annotations: str = "annotations", text: str = "data.text") -> DataFrame:
    """(id, text, annotator, label): a row for each choice of nested annotation results; rows without a label go."""
    a = df.select("id", F.col(text).alias("text"), F.explode(annotations).alias("a"))
    r = a.select("id", "text", F.col("a.completed_by").alias("annotator"), F.explode("a.result").alias("r"))
    return r.select("id", "text", "annotator", F.explode("r.value.choices").alias("label")).where(F.col("label").isNotNull())


def nested_annotations(df: DataFrame, id_key: str = "id", text: str = "text", label: str = "labels") -> DataFrame:
    """The other way: one JSON task a row, its label as a prediction."""
    result = F.struct(F.struct(F.array(F.col(label).cast("string")).alias("choices")).alias("value"), F.lit("label").alias("from_name"), F.lit("choices").alias("type"))
    return df.select(F.to_json(F.struct(F.col(id_key).alias("id"), F.struct(F.col(text).alias("text")).alias("data"), F.array(F.struct(F.array(result).alias("result"))).alias("predictions"))).alias("value"))


def pubmed(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, text) of MEDLINE citations in XML."""
    schema = "MedlineCitation struct<PMID string, Article struct<ArticleTitle string, Abstract struct<AbstractText array<string>>>>"
    df = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path)
    c = "MedlineCitation."
    return df.select(F.col(c + "PMID").alias("pmid"), F.col(c + "Article.ArticleTitle").alias("title"), F.array_join(c + "Article.Abstract.AbstractText", "\n").alias("text"))
