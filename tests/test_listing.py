"""Listing pages by HTTP from this machine, the manifest behind Bloom filters, and files that are fetched once."""

import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tenderlake.operators import bloom
from tenderlake.operators.bloom import bloom_filter, mark_possible, merged, missing_from, words_for
from tenderlake.sources.listing import listing_stream, read_listing
from tenderlake.sources.tables import materialize
from tenderlake.streaming.listing import Manifest, blocks, fetch_stream


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "file_name string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bound", [bloom.BROADCAST_WORDS, 0])
@pytest.mark.parametrize("words", [1, 50, 5000])
def test_missing_names_are_those_of_an_anti_join(spark, monkeypatch, words, bound):
    monkeypatch.setattr(bloom, "BROADCAST_WORDS", bound)
    dice = random.Random(words)
    known = [f"f{dice.randrange(3000)}.pdf" for _ in range(2000)] + [None, "", "é"]
    asked = sorted({f"f{dice.randrange(6000)}.pdf" for _ in range(1000)} | {"", "é", "ü"}) + [None]
    stored = names(spark, known)
    got = missing_from(names(spark, asked), stored, bloom_filter(stored, "file_name", words), "file_name", words)
    assert sorted(r[0] or "-" for r in got.collect()) == sorted(a or "-" for a in asked if a is None or a not in set(known))


def test_empty_sides(spark):
    none = names(spark, [])
    filters = bloom_filter(none, "file_name", 8)
    assert filters.count() == 0
    assert [r[0] for r in missing_from(names(spark, ["a"]), none, filters, "file_name", 8).collect()] == ["a"]
    assert missing_from(none, names(spark, ["a"]), bloom_filter(names(spark, ["a"]), "file_name", 8), "file_name", 8).count() == 0


def test_merged_filters_hold_all_names_and_rule_out_most_others(spark):
    words = words_for(4000)
    parts = [bloom_filter(names(spark, [f"{p} {i}" for i in range(1000)]), "file_name", words) for p in range(4)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    same = merged(whole)
    assert {tuple(r) for r in same.collect()} == {tuple(r) for r in bloom_filter(names(spark, [f"{p} {i}" for p in range(4) for i in range(1000)]), "file_name", words).collect()}
    asked = names(spark, [f"{p} {i}" for p in range(8) for i in range(1000)])
    marked = [tuple(r) for r in mark_possible(asked, whole, "file_name", words).collect()]
    assert len(marked) == 8000 and all(possible for name, possible in marked if name[0] in "0123")
    assert sum(possible for name, possible in marked if name[0] in "4567") < 4000 * 0.03


def test_the_manifest_is_filtered_before_it_is_shuffled_or_not_read(spark):
    stored = materialize(names(spark, [f"old {i}" for i in range(20_000)]), "stored")
    words = words_for(20_000)
    filters = materialize(bloom_filter(stored, "file_name", words), "filters")
    out = missing_from(names(spark, [f"old {i}" for i in range(5)] + [f"new {i}" for i in range(500)]), stored, filters, "file_name", words)
    assert out.count() == 500
    out.collect()
    scan = plan(out).split("stored-")[0]
    # Above the stored side's scan there is a join with a broadcast filter, and only above that an exchange.
    assert "BroadcastHashJoin" in scan and "LeftSemi" in scan
    shuffled = out._jdf.queryExecution().optimizedPlan().toString()
    assert shuffled.index("Aggregate [file_name") < shuffled.index("Join LeftSemi")
    # What no filter lets through leaves the manifest unread.
    nothing = missing_from(names(spark, ["quite new"]), stored, filters, "file_name", words)
    if "stored-" in plan(nothing):
        assert mark_possible(names(spark, ["quite new"]), filters, "file_name", words).first()["possible"]


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_blocks_cover_all_batches_once(fan):
    for n in range(200):
        found = blocks(n, fan)
        assert [b for level, first in found for b in range(first, first + fan**level)] == list(range(n))
        levels = [level for level, _ in found]
        assert all(levels.count(level) < fan for level in set(levels))


def test_manifest_by_batches_and_a_replay(spark, tmp_path):
    manifest = Manifest(spark, f"file://{tmp_path}/m", names=64, fan=2)
    stored = spark.createDataFrame([], "file_name string, file_url string")
    seen = set()
    for batch in range(9):
        new = [f"n{batch * 3 + i}" for i in range(3)]
        for _ in range(2 if batch in (3, 7) else 1):
            asked = names(spark, [*sorted(seen), *new])
            assert {r[0] for r in manifest.missing(asked, batch).collect()} == set(new)
            rows = spark.createDataFrame([(n, "u") for n in new], stored.schema)
            manifest.add(rows, batch)
        seen |= set(new)
    assert {r[0] for r in manifest.stored(9).collect()} == seen
    assert len(blocks(9, 2)) == 2


class Site:
    """A site on this machine: pages by path, and how often each was asked for."""

    def __init__(self):
        self.pages, self.asked = {}, []
        site = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self, body):
                found = site.pages.get(self.path)
                self.send_response(200 if found is not None else 404)
                if found is not None and self.path.startswith("/tagged"):
                    self.send_header("ETag", f'"{hash(found)}"')
                self.end_headers()
                if body:
                    site.asked.append(self.path)
                    self.wfile.write(found.encode() if found is not None else b"none")

            def do_GET(self):
                self.answer(True)

            def do_HEAD(self):
                self.answer(False)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.at = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def site():
    made = Site()
    yield made
    made.server.shutdown()


def test_a_batch_read_reports_what_fails(spark, site):
    site.pages["/a"] = "<p>é</p>"
    rows = {r["url"]: r for r in read_listing(spark, [f"{site.at}/a", f"{site.at}/b", "http://127.0.0.1:1/", "no address", f"{site.at}/a"], 5).collect()}
    assert len(rows) == 4
    assert (rows[f"{site.at}/a"]["status"], rows[f"{site.at}/a"]["html"]) == (200, "<p>é</p>")
    assert rows[f"{site.at}/b"]["status"] == 404
    assert rows["http://127.0.0.1:1/"]["status"] is None and rows["no address"]["error"]


def test_changed_pages_bring_new_files_once(spark, site, tmp_path):
    def link(*hrefs):
        return "".join(f'<a href="{h}">x</a>' for h in hrefs)

    def run():
        urls = [f"{site.at}/tagged", f"{site.at}/plain", f"{site.at}/late"]
        fetch_stream(listing_stream(spark, urls, 5), f"file://{tmp_path}/m", f"file://{tmp_path}/files", f"file://{tmp_path}/cp", names=100).awaitTermination()
        return {f.name: f.read_text() for f in (tmp_path / "files").iterdir() if f.is_file()} if (tmp_path / "files").exists() else {}

    site.pages |= {"/tagged": link("x/one.pdf", "gone/two.pdf", "page.html"), "/plain": link("y/one.pdf", "y/two.pdf", "y/two.pdf"), "/y/one.pdf": "one of y", "/y/two.pdf": "two", "/x/one.pdf": "one of x"}
    # Of a name's URLs that answer, the first in order of page and place.
    assert run() == {"one.pdf": "one of y", "two.pdf": "two"}
    before = len(site.asked)
    # Nothing has changed: the tagged page is not fetched again.
    assert len(run()) == 2 and "/tagged" not in site.asked[before:]
    site.pages |= {"/tagged": link("x/one.pdf", "x/three.docx"), "/x/three.docx": "three", "/late": link("x/four.pdf"), "/x/four.pdf": "four", "/y/one.pdf": "changed"}
    before = len(site.asked)
    assert run() == {"one.pdf": "one of y", "two.pdf": "two", "three.docx": "three", "four.pdf": "four"}
    asked = site.asked[before:]
    assert "/x/one.pdf" not in asked and "/y/one.pdf" not in asked and asked.count("/x/three.docx") == 1
