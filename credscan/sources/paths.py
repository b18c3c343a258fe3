"""Which paths a scan leaves out. Three scans, three lists (fixed values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".pdf", ".zip", ".bin", ".exe")
HISTORY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico",
    ".pdf", ".zip", ".tar", ".gz", ".7z", ".rar",
    ".exe", ".dll", ".so", ".bin", ".pyc", ".pyo",
    ".woff", ".woff2", ".ttf", ".eot",
    ".mp3", ".mp4", ".wav", ".avi",
    ".pkl", ".npy", ".npz", ".h5",
)
# Unanchored on purpose: compatible results need `.github/` and `rebuild.py`
# to be skipped as well. Pass another pattern to change that.
HISTORY_SKIP = (
    r"node_modules|\.git|venv|\.venv|dist|build|__pycache__|\.mypy_cache|\.pytest_cache"
    r"|package-lock\.json|yarn\.lock|Pipfile\.lock|poetry\.lock"
)
ENTROPY_SKIP = (
    r"/__tests__/|/fixtures/|/examples?/|/docs?/|\.md$|\.txt$|\.json$"
    r"|\.lock$|node_modules/|venv/|__pycache__/"
)


def extension(path: Column) -> Column:
    """The last suffix of the last path part, lower-cased; a leading dot alone
    makes a hidden file, not a suffix."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def is_binary_file(path: Column) -> Column:
    return extension(path).isin(*FILE_EXTENSIONS)


def skipped_in_history(path: Column, pattern: str = HISTORY_SKIP) -> Column:
    return extension(path).isin(*HISTORY_EXTENSIONS) | path.rlike("(?iu)" + pattern)


def skipped_by_entropy(path: Column) -> Column:
    return F.lower(path).rlike("(?d)" + ENTROPY_SKIP)
