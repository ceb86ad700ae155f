"""Restoring pseudonyms in streams of text chunks, whose tokens may be cut anywhere."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from palimpsest.operators.vault import TokenFormat

MAX_TOKEN_BYTES = 128
#: The largest vault that is sent to the tasks of a stream.
MAX_VAULT_BYTES = 64 << 20


class TokenTooLong(ValueError):
    """An open token is longer than allowed. Carries no text."""

    def __init__(self):
        super().__init__("token_too_long")


class Rehydrator:
    """feed(chunk) gives what can be shown, flush() the rest. A token restored is not looked at again."""

    def __init__(self, lookup, fmt: TokenFormat = TokenFormat(), unknown: str = "keep", max_token_bytes: int = MAX_TOKEN_BYTES, buffer: str = ""):
        if unknown not in ("keep", "error") or max_token_bytes < 1:
            raise ValueError("invalid options")
        self.lookup, self.fmt, self.unknown, self.most, self.buffer = lookup, fmt, unknown, max_token_bytes, buffer
        self.token = re.compile(re.escape(fmt.prefix) + r"[A-Za-z0-9_]+" + re.escape(fmt.suffix))

    def _restore(self, token: str) -> str:
        value = self.lookup(token)
        if value is None and self.unknown == "error":
            raise KeyError("unknown token")
        return token if value is None else value

    def _open(self, text: str) -> int:
        """Where the last token that may still be completed begins; the end of text if there is none."""
        prefix, suffix = self.fmt.prefix, self.fmt.suffix
        at = text.rfind(prefix)
        if at >= 0:
            body = text[at + len(prefix) :]
            name = re.match(r"[A-Za-z0-9_]*", body).group()
            if len(name) == len(body) or (name and suffix.startswith(body[len(name) :]) and body[len(name) :] != suffix):
                return at
        for k in range(min(len(prefix) - 1, len(text)), 0, -1):
            if prefix.startswith(text[-k:]):
                return len(text) - k
        return len(text)

    def feed(self, chunk: str) -> str:
        text = self.buffer + chunk
        cut = self._open(text)
        self.buffer = text[cut:]
        if len(self.buffer.encode()) > self.most:
            raise TokenTooLong()
        return self.token.sub(lambda m: self._restore(m.group()), text[:cut])

    def flush(self) -> str:
        out, self.buffer = self.buffer, ""
        return out


def rehydrate_stream(chunks: DataFrame, vault: dict[str, str], fmt: TokenFormat = TokenFormat(), unknown: str = "keep", max_token_bytes: int = MAX_TOKEN_BYTES, idle_ms: int | None = None) -> DataFrame:
    """chunks(stream_id string, seq long, chunk string, last boolean) -> stream_id, seq, output. The state of a stream is its open token; ``last`` flushes and ends it.

    All chunks of a stream in one micro-batch are restored in the order of seq; over micro-batches a source must deliver them in order. State is bounded by the streams that are open; with idle_ms a stream from which
    nothing comes for so long is flushed (seq null) and forgotten too (such a query runs until it is stopped). The vault of a session is sent to the tasks, up to MAX_VAULT_BYTES; a larger one
    is for the batch operator, which joins.
    """
    size = sum(len(k) + len(v) for k, v in vault.items())
    if size > MAX_VAULT_BYTES:
        raise ValueError("vault too large for a stream: restore in batches")
    sent = chunks.sparkSession.sparkContext.broadcast(vault)

    def run(key, frames, state):
        r = Rehydrator(sent.value.get, fmt, unknown, max_token_bytes, state.get[0] if state.exists else "")
        if state.hasTimedOut:
            state.remove()
            if r.buffer:
                yield pd.DataFrame({"stream_id": [key[0]], "seq": pd.array([None], dtype="Int64"), "output": [r.flush()]})
            return
        pdf = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out, over = [], False
        for chunk, last in zip(pdf["chunk"], pdf["last"]):
            out.append(r.feed(chunk or "") + (r.flush() if last else ""))
            over = bool(last)
        if over:
            if state.exists:
                state.remove()
        else:
            state.update((r.buffer,))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"stream_id": key[0], "seq": pdf["seq"].astype("Int64").to_numpy(), "output": out})

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq long, output string", "buffer string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def tumbling_stream(events: DataFrame, column: str = "ts", value: str = "value", window: str = "60 seconds", late: str = "2 minutes", *by: str) -> DataFrame:
    """Counts and means by event-time window, with a watermark so that state stays bounded."""
    return events.withWatermark(column, late).groupBy(F.window(column, window), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), *by, "n", "mean")


def bounded_source(spark, schema, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A Parquet stream that admits a bounded number of files for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
