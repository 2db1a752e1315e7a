"""Which folders of a lake count: each writer puts its files into a folder of its own and publishes them by one small log entry.

A lake is a folder with `events/part=NAME/...` and `_log/NAME.json`. An entry names the leaf folders that it adds and those that it replaces, and is
written under another name first, so it is there as a whole or not at all. Readers take the folders that have been added and not been replaced.
A writer that fails leaves nothing that counts; if it runs again under the same name, it overwrites its own folder. Replaced
folders stay readable for those who have found them already, until `vacuum`. A lake without a log is read as it lies.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

LOG, EVENTS = "_log", "events"


def fs_of(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_there(spark: SparkSession, path: str) -> bool:
    fs, p = fs_of(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = fs_of(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, path: str, target: str) -> bool:
    """Move a file; False if it is not there (any more)."""
    fs, p = fs_of(spark, path)
    if not fs.exists(p):
        return False
    _, t = fs_of(spark, target)
    fs.mkdirs(t.getParent())
    return fs.rename(p, t)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all; one of that name is replaced."""
    fs, p = fs_of(spark, path)
    _, draft = fs_of(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, p):  # some stores do not replace
        fs.delete(p, False)
        fs.rename(draft, p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = fs_of(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below the checkpoint folder; a local master without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clickloom-"))
        path = spark.sparkContext.getCheckpointDir()
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def files_below(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path below the folder, bytes) of all data files."""
    fs, p = fs_of(spark, folder)
    if not fs.exists(p):
        return []
    root, found = fs.makeQualified(p).toUri().getPath().rstrip("/"), []
    each = fs.listFiles(p, True)
    while each.hasNext():
        f = each.next()
        name = f.getPath().toUri().getPath()[len(root) + 1 :]
        if not any(part.startswith(("_", ".")) for part in name.split("/")):
            found.append((name, f.getLen()))
    return sorted(found)


def leaves(spark: SparkSession, root: str, part: str | None = None, data: str = EVENTS) -> list[str]:
    """The folders with data files below the folder of data (or one part of it)."""
    below = f"part={part}/" if part else ""
    return sorted({(below + name).rpartition("/")[0] for name, _ in files_below(spark, f"{root}/{data}/{below}")})


def publish(spark: SparkSession, root: str, name: str, added: list[str], removed: list[str] | tuple = (), **more) -> bool:
    """Make folders count; False if an entry of that name is there already."""
    path = f"{root}/{LOG}/{name}.json"
    if is_there(spark, path):
        return False
    write_text(spark, path, json.dumps({"name": name, "at": time.time(), "added": sorted(added), "removed": sorted(removed), **more}))
    return True


def is_published(spark: SparkSession, root: str, name: str) -> bool:
    return is_there(spark, f"{root}/{LOG}/{name}.json")


def entries(spark: SparkSession, root: str) -> list[dict]:
    """All log entries, the oldest first."""
    found = [read_text(spark, f"{root}/{LOG}/{name}") for name, _ in files_below(spark, f"{root}/{LOG}") if name.endswith(".json")]
    return sorted(map(json.loads, found), key=lambda e: (e["at"], e["name"]))


def current(spark: SparkSession, root: str) -> list[str] | None:
    """The leaf folders that count; None for a lake without a log."""
    log = entries(spark, root)
    if not log:
        return None
    return sorted({x for e in log for x in e["added"]} - {x for e in log for x in e["removed"]})


def adopt(spark: SparkSession, root: str) -> None:
    """Give a lake without a log one that names what lies there."""
    if current(spark, root) is None:
        publish(spark, root, "adopted", leaves(spark, root))


def vacuum(spark: SparkSession, root: str, older_than: float = 86_400.0, data: str = EVENTS) -> list[str]:
    """Delete folders that have been replaced for so many seconds. What has never been published is left alone: it may be in the making."""
    gone = []
    for e in entries(spark, root):
        if time.time() - e["at"] >= older_than:
            for leaf in e["removed"]:
                if is_there(spark, f"{root}/{data}/{leaf}"):
                    delete(spark, f"{root}/{data}/{leaf}")
                    gone.append(leaf)
    return gone
