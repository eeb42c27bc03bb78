"""Text extraction and string statistics, all in the JVM but for entropies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from watchloom.functions.columns import as_column
from watchloom.rules.reference_lists import CRITICAL_PATHS, HIGH_PATHS

# Indicator patterns.
IP_PATTERN = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
DOMAIN_PATTERN = (
    r"\b([a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*\.[a-zA-Z]{2,})\b"
)
HASH_PATTERN = r"\b([a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b"
URL_PATTERN = r"(?i)https?://[^\s\"'<>]+"
EMAIL_PATTERN = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"

# Counts of characters that one table holds.
COUNTS = 1 << 21


def _all(text: Column | str, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(group))


def _lower_distinct(found: Column) -> Column:
    return F.array_distinct(F.transform(found, F.lower))


def extract_ips(text: Column | str) -> Column:
    """Distinct IPv4 addresses; loopback, any and broadcast are noise."""
    return F.array_distinct(
        F.filter(_all(text, IP_PATTERN, 1),
                 lambda ip: ~ip.startswith("127.") & ~ip.isin("0.0.0.0", "255.255.255.255"))
    )


def extract_domains(text: Column | str) -> Column:
    return F.filter(_lower_distinct(_all(text, DOMAIN_PATTERN, 1)), lambda d: ~d.rlike(r"^[0-9.]*$"))


def extract_hashes(text: Column | str) -> Column:
    return _lower_distinct(_all(text, HASH_PATTERN, 1))


def extract_urls(text: Column | str) -> Column:
    return _lower_distinct(_all(text, URL_PATTERN, 0))


def extract_emails(text: Column | str) -> Column:
    return _lower_distinct(_all(text, EMAIL_PATTERN, 0))


def match_count(text: Column | str, pattern: str) -> Column:
    """Number of case-insensitive matches; 0 for missing text."""
    return F.coalesce(F.regexp_count(as_column(text), F.lit(f"(?i){pattern}")), F.lit(0))


def _char_entropies(texts: list[bytes | None]) -> np.ndarray:
    """Bits per character of each UTF-8 text, NaN for a missing one: one table of counts for all texts."""
    data = [t.decode("utf-8", "replace") if t else "" for t in texts]
    sizes = np.array([len(t) for t in data])
    chars = np.frombuffer("".join(data).encode("utf-32-le", "surrogatepass"), np.uint32)
    present = np.zeros(0x110000, dtype=bool)
    present[chars] = True
    number = np.cumsum(present) - 1
    width = max(1, int(present.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    terms = np.zeros(len(sizes))
    step = max(1, COUNTS // width)
    for k in range(0, len(sizes), step):
        own = sizes[k : k + step]
        places = np.repeat(np.arange(len(own)) * width, own) + number[chars[starts[k] : starts[k] + own.sum()]]
        counts = np.bincount(places, minlength=width * len(own)).reshape(-1, width)
        terms[k : k + step] = (counts * np.log2(np.maximum(counts, 1))).sum(axis=1)
    bits = np.where(sizes > 0, np.log2(np.maximum(sizes, 1)) - terms / np.maximum(sizes, 1), 0.0)
    return np.where([t is None for t in texts], np.nan, bits)


def shannon_entropy(text: Column | str, skip: str = "") -> Column:
    """Bits per character over the character frequencies; Arrow batches, since a native fold over the characters is interpreted."""
    text = as_column(text)
    text = F.replace(text, F.lit(skip), F.lit("")) if skip else text
    return _in_batches(_char_entropies, text.cast("binary"))


def _entropies(payloads: list[bytes | None]) -> np.ndarray:
    """Bits per byte of each payload, NaN for a missing one: one table of counts for all rows."""
    sizes = np.array([len(p) if p is not None else 0 for p in payloads])
    data = np.frombuffer(b"".join(p for p in payloads if p), np.uint8)
    counts = np.bincount(np.repeat(np.arange(len(sizes)) * 256, sizes) + data, minlength=256 * len(sizes)).reshape(-1, 256)
    terms = (counts * np.log2(np.maximum(counts, 1))).sum(axis=1)
    bits = np.where(sizes > 0, np.log2(np.maximum(sizes, 1)) - terms / np.maximum(sizes, 1), 0.0)
    return np.where([p is None for p in payloads], np.nan, bits)


def _in_batches(entropies: Callable[[list[bytes | None]], np.ndarray], payload: Column) -> Column:
    @F.pandas_udf("double")
    def bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for payloads in batches:
            parts = [entropies(payloads.iloc[k : k + 1024].tolist()) for k in range(0, len(payloads), 1024)]
            yield pd.Series(np.concatenate([np.zeros(0), *parts]))

    # Called nondeterministic so that filters on the result don't evaluate it again.
    return F.nanvl(bits.asNondeterministic()(payload), F.lit(None).cast("double"))


def byte_entropy(payload: Column | str) -> Column:
    """Bits per byte of a binary column; Arrow batches, since a native fold over the bytes is interpreted."""
    return _in_batches(_entropies, as_column(payload))


def consonant_ratio(text: Column | str) -> Column:
    letters = F.regexp_replace(as_column(text), "[^a-zA-Z]", "")
    consonants = F.regexp_replace(letters, "[aeiouAEIOU]", "")
    n = F.length(letters)
    return F.when(n > 0, F.length(consonants) / n).otherwise(F.lit(0.0))


def label_count(domain: Column | str) -> Column:
    return F.size(F.split(as_column(domain), r"\."))


def max_label_len(domain: Column | str) -> Column:
    return F.array_max(F.transform(F.split(as_column(domain), r"\."), F.length))


def path_severity(
    path: Column | str,
    critical: Sequence[str] = (),
    high: Sequence[str] = (),
    default: str = "medium",
) -> Column:
    """Severity of a change by path class; extra patterns extend the built-in ones."""
    lower = F.lower(as_column(path))
    return (
        F.when(lower.rlike("(?i)" + "|".join([*CRITICAL_PATHS, *critical])), "critical")
        .when(lower.rlike("(?i)" + "|".join([*HIGH_PATHS, *high])), "high")
        .otherwise(default)
    )


def fmt_ts(ms: Column | str) -> Column:
    ms = as_column(ms)
    shown = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")
    return F.when(ms == 0, "n/a").otherwise(F.concat(shown, F.lit(" UTC")))
