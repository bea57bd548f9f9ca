"""Reading a feed of server-sent events over HTTP."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.error import URLError
from urllib.request import Request, urlopen


def parsed(lines: Iterable[bytes]) -> Iterator[tuple[str, str]]:
    """(last event id, data) of every event that has data; an event ends with an empty line."""
    last, data = "", []
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            if data:
                yield last, "\n".join(data)
            data = []
            continue
        name, _, value = text.partition(":")
        value = value.removeprefix(" ")
        if name == "data":
            data.append(value)
        elif name == "id" and "\0" not in value:
            last = value


def read(url: str, last: str | None = None, most: int = 1000, timeout: float = 5.0) -> list[tuple[str, str]]:
    """At most ``most`` events after the event ``last``; fewer if the feed ends or is silent for ``timeout`` seconds."""
    headers = {"Accept": "text/event-stream", "Cache-Control": "no-cache"} | ({"Last-Event-ID": last} if last else {})
    out: list[tuple[str, str]] = []
    try:
        with urlopen(Request(url, headers=headers), timeout=timeout) as answer:
            for event in parsed(answer):
                out.append(event)
                if len(out) >= most:
                    break
    except (TimeoutError, URLError):
        if not out:
            raise
    return out
