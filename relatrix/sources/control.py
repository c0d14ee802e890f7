"""Around a run: the project lock, the status document, progress events, and a deadline for a command."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Files:
    """Small documents below a folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        sc = spark.sparkContext
        self.jvm = sc._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.root.getFileSystem(sc._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = True) -> None:
        """Raises the file system's error if the document exists and `overwrite` is off."""
        self.fs.mkdirs(self.root)
        stream = self.fs.create(self.at(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), False)


class ProjectLock:
    """One writer of a project at a time: a file that only one process can create.

    The same object may be entered again inside itself. A lock whose heartbeat is older than `stale_s` belongs to a lost
    process and is taken over; otherwise waiting ends after `wait_s` with an error.
    """

    def __init__(self, spark: SparkSession, folder: str, wait_s: float = 30.0, stale_s: float = 3600.0):
        self.files, self.wait_s, self.stale_s = Files(spark, folder), wait_s, stale_s
        self.owner, self.depth = uuid.uuid4().hex, 0

    def __enter__(self) -> "ProjectLock":
        end = time.monotonic() + self.wait_s
        while not self.depth:
            try:
                self.files.write(".lock", json.dumps({"owner": self.owner, "at": time.time()}), overwrite=False)
                break
            except Exception as e:  # the JVM's error for an existing file differs by file system
                held = self.files.read(".lock")
                if held is None:
                    if time.monotonic() >= end:
                        raise TimeoutError(f"the project cannot be locked: {e}") from e
                elif time.time() - self._stamp(held) > self.stale_s and self.files.read(".lock") == held:
                    self.files.delete(".lock")
                    continue
                elif time.monotonic() >= end:
                    raise TimeoutError(f"the project is locked: {held}") from None
            time.sleep(0.05)
        self.depth += 1
        return self

    @staticmethod
    def _stamp(text: str) -> float:
        try:
            return float(json.loads(text)["at"])
        except (ValueError, KeyError, TypeError):
            return 0.0

    def __exit__(self, *_) -> None:
        self.depth -= 1
        if not self.depth and (self.files.read(".lock") or "").find(self.owner) >= 0:
            self.files.delete(".lock")


def write_status(spark: SparkSession, folder: str, body: dict) -> None:
    Files(spark, folder).write("status.json", json.dumps(body, sort_keys=True))


def read_status(spark: SparkSession, folder: str) -> dict:
    """The last status; empty if there is none or it is broken."""
    try:
        body = json.loads(Files(spark, folder).read("status.json") or "{}")
    except ValueError:
        return {}
    return body if isinstance(body, dict) else {}


class DeadlineExceeded(TimeoutError):
    pass


def within(spark: SparkSession, seconds: float, command: Callable, *args, **kwargs):
    """The command's result, or DeadlineExceeded after `seconds`; its Spark jobs are then cancelled by their tag."""
    tag = f"deadline-{uuid.uuid4().hex}"
    box: dict = {}

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            box["value"] = command(*args, **kwargs)
        except BaseException as e:  # handed to the caller's thread
            box["error"] = e

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.sparkContext.cancelJobsWithTag(tag)
        raise DeadlineExceeded(f"the command took more than {seconds:g} s")
    if "error" in box:
        raise box["error"]
    return box["value"]
