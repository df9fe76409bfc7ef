"""Single files by URI, for tasks and the driver: local, S3 (also s3a, and anonymous), GCS, HDFS and Azure."""

from __future__ import annotations

from urllib.parse import parse_qs, urlsplit

_SAME = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}


def split(uri: str) -> tuple[str, bool]:
    """The URI as Arrow knows it, and whether ?anon=true or ?anon=1 asks for unsigned requests. A path is a local file."""
    at = urlsplit(uri)
    if not at.scheme:
        return "file://" + (uri if uri.startswith("/") else "/" + uri), False
    anonymous = at.scheme in ("s3", "s3a", "s3n") and parse_qs(at.query).get("anon", [""])[0] in ("true", "1")
    return _SAME.get(at.scheme, at.scheme) + uri[len(at.scheme) :].split("?anon=")[0], anonymous


def filesystem(uri: str):
    """(file system, path in it). Credentials are those of the environment."""
    from pyarrow import fs

    own, anonymous = split(uri)
    if anonymous:
        return fs.S3FileSystem(anonymous=True), own.removeprefix("s3://")
    return fs.FileSystem.from_uri(own)


def open_input(uri: str, seek: bool = False):
    system, path = filesystem(uri)
    return system.open_input_file(path) if seek else system.open_input_stream(path)


def open_output(uri: str):
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def delete(uri: str) -> None:
    system, path = filesystem(uri)
    system.delete_file(path)


_registered: dict[str, str] = {}


def register(name: str, table) -> str:
    """Makes a DataFrame readable as memory://name until unregister; its rows are written to the shared folder."""
    from ..session import scratch

    path = scratch(table.sparkSession, "memory")
    table.write.parquet(path)
    _registered[name] = path
    return name


def register_bytes(spark, name: str, data: bytes) -> str:
    """Makes the bytes of one Parquet file readable as memory://name until unregister."""
    from ..session import scratch

    path = scratch(spark, "memory") + ".parquet"
    with open_output(path) as out:
        out.write(data)
    _registered[name] = path
    return name


def unregister(name: str) -> None:
    _registered.pop(name, None)


def resolve(uri: str) -> str:
    """The place of a memory:// table; any other URI as it is."""
    if not uri.startswith("memory://"):
        return uri
    if uri not in _registered:
        raise FileNotFoundError(f"nothing is registered as {uri}")
    return _registered[uri]


def for_spark(spark, uri: str) -> str:
    """The URI as Spark reads it: memory:// by its registered place, s3 becomes s3a, and ?anon=true makes its bucket's requests unsigned."""
    uri = resolve(uri)
    own, anonymous = split(uri)
    if not own.startswith("s3://"):
        return uri
    if anonymous:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        conf.set(f"fs.s3a.bucket.{urlsplit(own).netloc}.aws.credentials.provider", "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider")
    return "s3a" + own[2:]
