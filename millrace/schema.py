"""Schemas of lines, blocks, events and summaries."""

from __future__ import annotations

LINES = "log_id string, line_no long, line string"

LOCATION = "struct<file:string,line:int,column:int>"
FRAME = "struct<file:string,line:int,function:string,vendor:boolean>"

#: What segmentation gives and projection reads. ``emit`` and ``rank`` order a log's events.
BLOCKS = "log_id string, emit long, rank int, format string, kind string, severity string, header string, body array<string>, context array<string>, attrs map<string,string>"

EVENTS = (
    f"log_id string, seq long, severity string, kind string, title string, location {LOCATION}, body array<string>, context array<string>, "
    f"frames array<{FRAME}>, frames_collapsed int, count int, truncated boolean, metadata map<string,string>"
)


def names(ddl: str) -> list[str]:
    """Column names of a schema text."""
    out, depth, word = [], 0, ""
    for c in ddl + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out


EVENT_COLUMNS = names(EVENTS)
