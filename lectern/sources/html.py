"""Links and titles of board pages that were fetched before."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import attachment_name, col


def page_title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def needs_login(html: Column | str) -> Column:
    return F.contains(page_title(html), F.lit("Login"))


class _Links(HTMLParser):
    """Links with the (tag, classes) chain around them."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, set[str]]] = []
        self.links: list[dict] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.links.append({"href": a["href"], "text": "", "around": list(self.open)})
        if tag not in self.VOID:
            self.open.append((tag, set((a.get("class") or "").split())))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.links and any(t == "a" for t, _ in self.open):
            self.links[-1]["text"] += data


def under(around: list[tuple[str, set[str]]], path: list[tuple[str, str | None]]) -> bool:
    """Whether the chain holds the tags of ``path`` in order, each with its class if it names one."""
    i = 0
    for tag, classes in around:
        if i < len(path) and tag == path[i][0] and (path[i][1] is None or path[i][1] in classes):
            i += 1
    return i == len(path)


def links_of(html: str) -> tuple[str | None, str | None, str | None]:
    """(first topic link, href and text of the first SM or WM attachment) of a page."""
    p = _Links()
    p.feed(html or "")
    topic = next((x["href"].split("#")[0] for x in p.links if "topic=" in x["href"] and under(x["around"], [("td", "subject"), ("div", None), ("span", None)])), None)
    file = next((x for x in p.links if under(x["around"], [("div", "attachments")]) and x["text"].strip().upper().startswith(("SM", "WM"))), None)
    return topic, file and file["href"], file and file["text"].strip()


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, login, topic, attachment, file): file is the cleaned name of the attachment."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([(i, *links_of(h)) for i, h in zip(pdf["page_id"], pdf["html"])], columns=["page_id", "topic", "attachment", "label"])

    found = pages.select("page_id", "html").mapInPandas(parse, "page_id long, topic string, attachment string, label string")
    login = pages.select("page_id", needs_login("html").alias("login"))
    return found.join(login, "page_id").select("page_id", "login", "topic", "attachment", F.when(F.col("label").isNotNull(), attachment_name("label")).alias("file"))
