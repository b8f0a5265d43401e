"""Builds read back: SQLite and compact files, dictionaries, downloads, postings with prefixes."""

import http.server
import threading

import pytest

from placeforge import cli
from placeforge.operators import index, search
from placeforge.plans import build as B
from placeforge.sources import files, regions

ROWS = [
    (1, 1, 0, 55.0, 37.0, "Россия", "Москва", "улица Тверская", "1", "125009", None, None),
    (2, 2, 0, 55.1, 37.1, "Россия", "Москва", "улица Ленина", "7", None, None, None),
    (3, 3, 1, 55.2, 37.2, "Россия", "Москва", None, None, None, "Красная площадь", "historic"),
]
NAMES = "id long, seq long, type int, lat double, lon double, country string, city string, street string, housenumber string, postcode string, name string, category string"


@pytest.fixture(scope="module")
def objects(spark):
    return spark.createDataFrame(ROWS, NAMES)


def test_a_sqlite_build_is_searched_and_read(spark, objects, tmp_path, capsys):
    path = f"{tmp_path}/x.db"
    files.export_sqlite(objects, B.meta(objects, "RU-MOW", source="x.osm.pbf"), path)
    lines = cli.main(["query", path, "тверская 1"])
    assert [x for x in lines if "Тверская" in x] and "  (nothing found)" in lines
    assert any("Красная площадь (historic)" in x for x in cli.main(["query", path, "красн"]))
    lines = cli.main(["info", path])
    assert "source: x.osm.pbf" in lines and "objects 3, addresses 2, named 1" in lines
    got = files.read_sqlite(spark, path, parts=2).orderBy("id").collect()
    assert [(r.id, r.city, r.name, r.lat) for r in got] == [(r[0], r[6], r[10], r[3]) for r in ROWS]


def test_a_compact_build_is_reported_and_searched(objects, tmp_path):
    path = f"{tmp_path}/x.bin"
    index.write_compact(objects, path, "RU-MOW", 5)
    lines = cli.main(["info", path])
    assert "records 3: addresses 2, named 1" in lines and "named index in order" in lines and "  Красная площадь" in lines
    assert cli.main(["query", path, "КРАСН"])[0].startswith("  Красная площадь")
    assert cli.main(["query", path, "нет"]) == ["  (nothing found)"]


def test_dictionary_search(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(files, "PLACES", ["a.txt", "b.txt"])
    monkeypatch.delenv("PLACEFORGE_DICTIONARY", raising=False)
    assert files.find_dictionary() is None
    assert files.find_dictionary(None, "http://x/d.txt", lambda url, to: f"{url} {to}") == "http://x/d.txt a.txt"
    (tmp_path / "b.txt").write_text("слово 5\n")
    assert files.find_dictionary() == "b.txt"
    with pytest.raises(FileNotFoundError):
        files.find_dictionary("none.txt")
    assert files.megabytes(1_572_864) == "1.5 MB"


def test_region_paths_and_downloads(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    seen = []
    fetch = lambda url, to: seen.append((url, to)) or to
    assert regions.resolve_input("russia/central-fed-district", fetch, "http://h") == "central-fed-district-latest.osm.pbf"
    assert seen == [("http://h/russia/central-fed-district-latest.osm.pbf", "central-fed-district-latest.osm.pbf")]
    with pytest.raises(FileNotFoundError):
        regions.resolve_input("./no/file.osm.pbf", fetch, "http://h")
    body = b"0123456789" * 1000

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()

        def do_GET(self):
            start = int((self.headers.get("Range") or "bytes=0-")[6:-1])
            self.send_response(206 if start else 200)
            self.end_headers()
            self.wfile.write(body[start:])

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    (tmp_path / "part").write_bytes(body[:4321])
    for to in ("new", "part", "part"):
        assert (tmp_path / regions.download(url, to)).read_bytes() == body
    server.shutdown()


def test_postings_carry_prefixes(spark, objects):
    posted = B.text_index(objects, 0)
    rows = {r.term: (r.p2, r.p3, r.p4) for r in posted.collect()}
    assert rows["1"] == (None, None, None) and rows["улиц"] == ("ул", "ули", "улиц")
    for terms in (["т"], ["тв"], ["тве"], ["тверс"], ["улиц", "лен"], ["1"]):
        assert sorted(map(tuple, search.hits(posted, terms).collect())) == sorted(map(tuple, search.hits(posted.drop("p2", "p3", "p4"), terms).collect()))
    plan = search.hits(posted, ["тверс"])._jdf.queryExecution().optimizedPlan().toString()
    assert "твер" in plan


def test_generate(spark, tmp_path):
    (tmp_path / "names.txt").write_text("Ленина\nМира\n\nЛенина\n")
    out = str(tmp_path / "pairs")
    found = dict(line.split(": ") for line in cli.main(["generate", str(tmp_path / "names.txt"), out, "--seed", "7"]))
    found = {k: int(n) for k, n in found.items()}
    assert (found["abbreviation_pairs"], found["oblique_pairs"], found["adjective_agreement_pairs"], found["noop_pairs"]) == (144, 176, 15 * 6 + 9 * 6 + 3 * 3 + 14, 2 * 19 + 18)
    train, val = (spark.read.json(f"{out}/{s}.jsonl") for s in ("train", "val"))
    assert (train.count(), val.count()) == (found["train_pairs"], found["val_pairs"]) and train.count() + val.count() == found["total_pairs"]
    both = train.unionByName(val)
    assert both.distinct().count() == found["total_pairs"] < sum(n for k, n in found.items() if k not in ("total_pairs", "train_pairs", "val_pairs"))
    assert both.filter("input = 'ул. Ленина'").first().output == "улица Ленина" and both.filter("input = 'Синей поле'").first().output == "Синее поле"
    assert spark.read.csv(f"{out}/val.tsv", sep="\t", header=True).count() == found["val_pairs"]
    assert spark.read.json(f"{out}/stats.json").first().asDict() == found
