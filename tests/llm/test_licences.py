import re
from pathlib import Path

import duckdb
import pytest

from tidemark.llm import licences as L
from tidemark.llm.known_licences import KNOWN, MORE, WHOLE

MIT = next(t for i, t in KNOWN if i == "MIT" and t.startswith("MIT License"))


def found(df):
    return {(r.doc_id, r.unit, r.position): r.license_id for r in L.scan(df).collect()}


@pytest.mark.parametrize(
    "change",
    [
        lambda t: t, str.upper, lambda t: t.replace("\n\n", "\n\nCopyright (c) 2020 Some One <a@b.c>\nAll rights reserved.\n\n", 1), lambda t: "".join("// " + x + "\n" for x in t.split("\n")),
        lambda t: t.replace(", ", " ,\n"), lambda t: t.replace("License", "Licence").replace("sublicense", "sub-license"), lambda t: t.replace('"', "“").replace("NONINFRINGEMENT", "NON-INFRINGEMENT"),
    ],
)
def test_a_known_text_in_another_dress(docs_of, change):
    assert found(docs_of([(1, change(MIT))]))[1, "text", 0] == "MIT"


def test_changed_terms_are_not_known(docs_of):
    assert found(docs_of([(1, MIT.replace("free of charge", "for a fee"))]))[1, "text", 0] is None


def test_notices_inside_texts(docs_of):
    got = found(docs_of([(1, "Some words.\n\n  Licensed under the APACHE licence, version 2.0\nMore.")]))
    assert got == {(1, "text", 0): None, (1, "line", 2): "Apache-2.0"}


def test_same_as_sql(documents, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(map(str, con.execute(f"select doc_id, unit, position, digest, license_id from ({L.SQL})").fetchall()))
    assert sorted(str(tuple(r)) for r in L.scan(documents).collect()) == want


def test_edges(docs_of, edges, spark):
    got = [r for r in L.scan(docs_of([*edges, (9, "Copyright (c) 2001 A. Author")])).collect() if r.unit == "text"]
    assert len(got) == len(edges) + 1
    assert {r.doc_id for r in got if r.digest is None} == {1, 2, 3, 9} and all(r.license_id is None for r in got)
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


BSD2, BSD3 = (next(t for i, t in KNOWN if i == f"BSD-{k}-Clause") for k in (2, 3))
SHIPPED = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3-only"}


def test_usual_headings_and_list_markers(docs_of):
    body = MIT.split("\n\n", 1)[1]
    isc = next(t for i, t in KNOWN if i == "ISC" and not t.startswith("ISC"))
    texts = [("MIT", f"The MIT License (MIT)\n\nCopyright (c) 2020 A. B.\n\n{body}"), ("MIT", f"# MIT License\n{body}"), ("ISC", f"The ISC License\n\n{isc}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) 2021, C\n\n{BSD3}"),
             ("BSD-3-Clause", "New BSD License\n" + re.sub(r"(?m)^[0-9]\. ", "  * ", BSD3)), ("BSD-3-Clause", re.sub(r"(?m)^([0-9])\. ", r"(\1) ", BSD3)), ("BSD-2-Clause", 'BSD 2-Clause "Simplified" License\n' + re.sub(r"(?m)^[0-9]\. ", "- ", BSD2)), *MORE]
    got = found(docs_of([(i, t) for i, (_, t) in enumerate(texts)]))
    assert [got[i, "text", 0] for i in range(len(texts))] == [i for i, _ in texts]


def test_bare_forms_are_whole_texts_only(docs_of):
    other = BSD3.replace("2. Redistributions in binary form must", "2. Redistributions in binary form need not")
    got = found(docs_of([(1, "The MIT License"), (2, f"MIT License\n{BSD3}"), (3, other), (4, f"BSD License\n{BSD3}\nAnd one more term."), (5, "This work is licensed under the GNU General Public License, version\n3. ")]))
    assert [got[i, "text", 0] for i in range(1, 6)] == [None, "BSD-3-Clause", None, None, "GPL-3.0-only"]


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence texts on this machine")
def test_long_published_texts(docs_of):
    texts = {k: Path("/usr/share/common-licenses", k).read_text() for k in SHIPPED}
    gpl2 = texts["GPL-2"]
    more = {"old address": gpl2.replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301", "59 Temple Place, Suite 330, Boston, MA  02111-1307"), "no appendix": gpl2[: gpl2.index("How to Apply")], "wrapped": gpl2.replace(" of the ", " of\nthe ")}
    names = [*texts, *more]
    got = found(docs_of(list(enumerate([*texts.values(), *more.values(), gpl2.replace("charge a fee", "charge no fee"), gpl2[:9000]]))))
    assert [got[i, "text", 0] for i in range(len(names) + 2)] == [*SHIPPED.values(), *["GPL-2.0-only"] * 3, None, None]
    assert len(WHOLE) == len(set(WHOLE))
    assert all(re.search(L.LICENSED, t.lower()) for t in texts.values())


def test_word_of_every_whole_text():
    assert all(re.search(L.LICENSED, t.lower()) for _, t in [*KNOWN, *MORE] if len(t.split()) >= 40)
    assert re.search(L.LICENSED, "the soft-ware")
