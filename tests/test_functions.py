"""Column functions, many cases per plan."""

import hashlib

from pyspark.sql import functions as F

from fileledger.functions import hashes, paths, risk, text
from fileledger.operators.parsing import apply_parsing, combined_review, parse_notes
from fileledger.settings import profile_settings
from fileledger.sources.observations import with_canonical_columns


def check(spark, function, cases, kind="string"):
    """``cases``: input -> expected output of ``function``."""
    rows = list(cases.items())
    df = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(rows)], f"i int, v {kind}")
    got = {r["i"]: r["x"] for r in df.select("i", function(F.col("v")).alias("x")).collect()}
    assert {rows[i][0]: got[i] for i in got} == dict(rows)


def test_spaces(spark):
    check(spark, text.normalize_spaces, {
        None: None, "": None, "  ": None, " NaN ": None, "none": None, "[]": None, "{}": None, "nan x": "nan x",
        " a \t b\n": "a b", "a RE(3)": "a", "a re(12) ": "a", "RE(3)": "RE(3)", "a\u00a0\u2003b": "a b",
    })


def test_hashes_and_ids(spark):
    h = "ab" * 16
    check(spark, hashes.valid_hash, {f" {h} ": h.upper(), h * 2: (h * 2).upper(), "xy": None, None: None, h + "a": None})
    plain = "11111111-2222-3333-4444-555555555555"
    check(spark, hashes.canonical_uuid, {
        plain: plain, "{" + plain.upper() + "}": plain, "urn:uuid:" + plain: plain, plain.replace("-", ""): plain,
        "1": None, None: None, plain + "0": None,
    })
    check(spark, hashes.valid_id, {"1": True, "007": True, "0": False, "-1": False, "x": False, None: False, "9" * 30: True})


def test_paths(spark):
    check(spark, paths.normalize_path, {
        r'"C:/Program Files//X\\Y.exe"': r"c:\program files\x\y.exe", "//Usr//bin/": "/usr/bin", "/": "/", "//": "/",
        "foo Bar": "foo bar", r"C:\a process=b": r"c:\a", "/a Added By: bob": "/a", "/a merged by: x 2024-01-01 z": "/a",
        r"\\Server\Share": r"\\server\share", "c:": "c:", "": None, "'c:\\a'": "c:\\a",
    })
    check(spark, paths.wildcard_user_profile, {r"c:\users\bob\x": r"c:\users\*\x", "/users/bob": "/users/*", r"d:\users\bob": r"d:\users\bob"})
    guid = "{00000000-1111-2222-3333-444444444444}"
    check(spark, paths.collapse_versions, {
        r"c:\v1.2\1.2.3\r12\2024\en-us\x": r"c:\*\*\*\*\*\x", f"/a/{guid}/1234567890/{'a' * 16}/b": "/a/*/*/*/b",
        r"c:\1\v2\r1234\1999": r"c:\1\v2\r1234\1999",
    })
    check(spark, paths.volatile_shape, {
        r"c:\004354ly\abc.tmp-0\deadbeef\en\1.2\keep": r"c:\<VOLATILE>\<VOLATILE>\<VOLATILE>\<VOLATILE>\<VOLATILE>\keep",
        "/opt/abcdef/*": "/opt/abcdef/*",
    })
    check(spark, paths.shorten_leaf, {
        r"c:\a\b.exe": r"c:\a\*", r"c:\a\b.msi": r"c:\a\*.msi", r"c:\a": r"c:\a", r"c:\*\b.exe": r"c:\*\b.exe", "/usr/bin": "/usr/*", "/usr": "/usr",
    })
    check(spark, paths.extension, {r"c:\v 1.2\x": "", r"c:\a\x.DLL": ".DLL", "/a/.profile": "", "/a/b.tar.gz": ".gz", "x.": "."})
    check(spark, paths.looks_like_file, {"a.exe": True, "*": False, "*.dll": True, ".profile": False, "a.verylongextension": False, "plain": False})
    check(spark, lambda c: F.concat_ws("|", paths.segments(c)), {r"c:\a\b": "a|b", "/a/b": "a|b", "c:": "", r"\\s\t": "s|t"})
    check(spark, paths.macos_target_path, {"/applications/x.app/contents/y": "/applications/x.app/*", "/library/frameworks/python.framework/versions/3.9/bin": "/library/frameworks/python.framework/versions/*/bin"})
    check(spark, paths.posix_depth, {"/a/b/c": 3, r"c:\a": 0})


def test_heads(spark):
    settings = profile_settings("balanced")

    def head(path):
        parts = paths.segments(path)
        folders = paths.directory_segments(parts)
        return paths.group_head(paths.root(path), parts, folders, paths.separator(path), settings)

    check(spark, head, {
        r"c:\program files\vendor\app.exe": r"c:\program files\vendor",
        r"c:\program files\vendor\app\bin\x\tool.exe": r"c:\program files\vendor\app",
        r"c:\data\a\b\c\d.txt": r"c:\data\a\b", "/opt/a/b/c/d": "/opt/a/b",
    })


def test_embedded_paths(spark):
    cells = {
        r"c:\a\x.exe; c:\b\y.exe c:\a\x.exe": [r"c:\a\x.exe", r"c:\b\y.exe"],
        r"see c:\a b\x.exe Hash: 12": [r"c:\a b\x.exe"], "/usr/bin": ["/usr/bin"], "name": ["name"],
    }
    df = spark.createDataFrame([(k,) for k in cells], "v string")
    exploded = df.select("v", F.explode_outer(paths.embedded_parts(F.col("v"))).alias("p"))
    got = {}
    for r in exploded.select("v", paths.embedded_path(F.col("p")).alias("p")).collect():
        got.setdefault(r["v"], []).append(r["p"])
    assert got == cells


def test_certificates(spark):
    check(spark, lambda c: F.concat_ws("#", text.split_certificates(text.tidy(c))), {
        "CN=a; O=b ;; none": "CN=a#O=b", '[{"subject":"CN=a","sha":"1"},{"sha":"2"},{"subject":"x"}]': "CN=a | sha=1#2#x",
        "[]": "", "[not json]": "[not json]",
    })
    check(spark, lambda c: text.primary_certificate(F.split(c, ";")), {"Microsoft Corporation;acme": "acme", "microsoft corporation": "microsoft corporation"})
    check(spark, text.certificate_condition, {"CN=x, O=Autodesk, Inc.": "o=autodesk", "cn=Portswigger Ltd": "o=portswigger", "o = a": "o=a", None: None})


def test_values_are_evaluated_once(spark):
    df = spark.createDataFrame([("CN=a; O=b", r"C:\a\b.exe")], "c string, p string")
    plan = df.select(
        text.certificate_vendor(F.col("c")).alias("v"), text.certificate_condition(F.col("c")).alias("o"),
        paths.embedded_parts(F.col("p")).alias("e"),
    )._jdf.queryExecution().optimizedPlan().toString()
    # Twice for the two forms of a certificate, once for the cell.
    assert plan.count("lower(") == 2 and plan.count("translate(") == 1
    check(spark, text.none_if_empty, {"": None, " ": " ", None: None, "a": "a"})
    check(spark, lambda c: F.to_json(text.note_hashes(c)), {
        "x " + "a" * 32: '{"md5":"' + "a" * 32 + '"}', "a" * 40 + " " + "b" * 32: '{"sha1":"' + "a" * 40 + '"}',
        "b" * 32 + " " + "c" * 64: '{"sha256":"' + "c" * 64 + '"}', "none": "{}",
    })


def test_matching(spark):
    cases = {("a*", "ABC", True): True, ("a*", "ABC", False): False, ("", "x", True): True, ("a", "", True): False,
             ("a%_", "a%_", True): True, ("a%", "abc", True): False, (r"c:\*\x", r"c:\a\b\x", True): True, (None, None, True): True, ("*", None, True): False,
             ("a*a", "a", True): False, ("a*b*c", "abc", True): True, ("a*b*b", "ab", True): False, ("*b*", "abc", True): True,
             ("a*x*c*e", "abxdcde", True): True, ("a*x*c*e", "abdcde", True): False, ("a**", "ab", True): True, ("a\\*%b*c*", "a\\z%bcd", True): True}
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, p string, v string, f boolean")
    hit = F.when(F.col("f"), text.matches(F.col("p"), F.col("v"))).otherwise(text.matches(F.col("p"), F.col("v"), False))
    got = {r["i"]: r["m"] for r in df.select("i", hit.alias("m")).collect()}
    assert list(cases.values()) == [got[i] for i in range(len(cases))]


def test_labels(spark):
    check(spark, text.canonical_label, {"Host:": "hostname", "SHA256:": "sha256_hash", "Hash:": "hash", "Process Name:": "process_path", "Publisher:": "certificate_raw", "Created By:": "created_by", "Added by x:": "added_by", "Other:": "other"})


def test_note_fields(spark):
    h40, h64 = "c" * 40, "d" * 64
    notes = {
        "last": "Path: c:\\a.exe Path: c:\\b.exe", "emptied": "Path: c:\\a.exe Path:", "bare": "ran d:\\tool\\x.exe",
        "cn": "signed CN=Acme Ltd; more", "sha1": f"id {h40} x", "sha256": f"id {h64}", "added": "Added by bob 2024-01-02 UTC: yes",
        "crlf": "Process Path: C:\\p.exe\r\nHost: h1\r\nCertificates: CN=a; O=b", "none": "nan",
    }
    df = spark.createDataFrame(list(notes.items()), "k string, notes string")
    got = {r["k"]: r for r in parse_notes(df, "notes", "").collect()}
    assert got["last"]["path"] == "c:\\b.exe" and got["bare"]["path"] == "d:\\tool\\x.exe"
    # The last label wins even when empty; the text is then searched for a path.
    assert got["emptied"]["path"].startswith("c:\\a.exe")
    assert got["cn"]["certificate_primary"] == "CN=Acme Ltd"
    assert (got["sha1"]["sha1"], got["sha1"]["sha256_hash"], got["sha1"]["md5_hash"]) == (h40, None, None)
    assert got["sha256"]["sha256_hash"] == h64
    assert (got["added"]["added_by"], got["added"]["timestamp_utc"]) == ("yes", "2024-01-02 UTC")
    assert (got["crlf"]["process_path"], got["crlf"]["hostname"], got["crlf"]["certificate_all"]) == ("c:\\p.exe", "h1", "CN=a; O=b")
    assert all(v is None for k, v in got["none"].asDict().items() if k not in ("k", "notes"))


def test_direct_columns_and_aliases(spark):
    df = spark.createDataFrame(
        [(1, r"c:\a\x.exe c:\b\y.exe", "c:\\p.exe", "Autodesk Inc", None, "bob", "h", "3"), (2, "/x", None, "/usr/bin/python3", "x", None, None, "z")],
        "id int, `Full Path` string, Process string, Certificate string, Hash string, `Created By` string, `Host Name` string, Count string",
    )
    parsed = apply_parsing(df)
    rows = [(r["id"], r["path"], r["process_path"], r["certificate_primary"], r["count"]) for r in parsed.orderBy("id", "path").collect()]
    assert rows == [(1, r"c:\a\x.exe", "c:\\p.exe", "autodesk", 3), (1, r"c:\b\y.exe", "c:\\p.exe", "autodesk", 3), (2, "/x", "/usr/bin/python3", None, 1)]
    assert combined_review(parsed).columns == ["Path", "Process Path", "Certificate", "Created By", "SHA256", "MD5", "Host Name", "Timestamp", "Count"]
    twice = spark.createDataFrame([(1, 2)], "`path ` int, `Full Path` int")
    assert [tuple(r) for r in with_canonical_columns(twice).collect()] == [(2,)]


def test_risk_predicates(spark):
    check(spark, risk.is_high_risk_process, {r"c:\x\cmd.exe": True, r"c:\windows\notepad.exe": True, r"c:\windows\readme.txt": False, r"c:\app\run.exe": False, "/bin/bash": True, "/tmp/x": True, "/opt/x": False, None: False})
    check(spark, risk.is_dangerous_user_wildcard, {r"c:\users\*\*": True, r"c:\users\*.dll": True, r"c:\users\bob\*.exe": True, r"c:\users\bob\x.exe": False, r"c:\vendor\*": False, None: False})
    check(spark, risk.is_user_writable, {r"c:\users\x": True, r"c:\programdata\x": True, r"c:\program files\x": False})
    check(spark, risk.is_python_package_artifact, {"/users/b/p/.venv/lib/x.so": True, "/users/b/p/.venv/lib/x.py": False, "/users/b/.venv/x.so": False})
    check(spark, risk.is_overbroad_macos, {"/applications/*/*": True, "/users/*/library/*": True, "/applications/x.app/*": False})


def test_trimming_reads_only_the_ends(spark):
    spaces = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    values = ["", "ab", "é", *spaces, *[f"{s}a{s}b{s}{s}" for s in spaces], "".join(spaces), "​a", "x\x00", "\x1b", "ü "]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    pattern = F.regexp_replace("v", f"^{text._SPACE}+|{text._SPACE}+$", "")
    trimmed = df.select("v", text.strip(F.col("v")).alias("x"), pattern.alias("y"))
    assert trimmed.filter("not (x <=> y)").collect() == []
    plan = df.select(hashes.valid_hash(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_uuids_in_usual_spellings_are_not_searched_for_decorations(spark):
    plain = "0a1b2c3d-2222-3333-4444-5555deadbeef"
    bare = plain.replace("-", "")
    odd = [
        plain, plain.upper(), bare, "{" + plain + "}", "{" + bare + "}", "{" + plain, plain + "}", "{{" + plain + "}}", plain + "\n",
        bare + "\n", "{" + plain + "}\n", "}" + plain, plain + "{", bare + "\r\n", plain + " ", " " + bare, "urn:uuid:{" + bare + "}",
        bare + "0", bare[:-1], plain[:-1] + "g", bare[:-1] + "G", "0a1b-" + bare[4:], "-" + bare + "-", bare[:8] + "uuid:" + bare[8:], "", None,
        plain[:8] + plain[9:], "{" + plain + "}}", plain + "\n\n", "٠" + bare[1:],
    ]
    df = spark.createDataFrame([(v,) for v in odd], "v string")
    undecorated = F.regexp_replace(F.lower("v"), hashes._DECORATION, "")
    hyphenated = F.regexp_replace(undecorated, hashes._DIGITS, "$1-$2-$3-$4-$5")
    expected = F.nullif(F.regexp_extract(hyphenated, hashes._CANONICAL, 0), F.lit(""))
    found = df.select("v", hashes.canonical_uuid(F.col("v")).alias("x"), expected.alias("y"))
    assert found.filter("not (x <=> y)").collect() == []
    assert found.filter("x is not null").count() > 10
    plan = found.select("x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("regexp_replace")


def test_usual_uuids_and_hashes_need_no_lambda(spark):
    plain = "0a1b2c3d-2222-3333-4444-5555deadbeef"
    rows = spark.createDataFrame([(plain,)], "v string")
    constant = rows.select(hashes.canonical_uuid(F.lit("{" + plain.upper() + "}")).alias("x"))
    assert constant.first()["x"] == plain
    assert "lambda" not in constant._jdf.queryExecution().optimizedPlan().toString()
    hashed = rows.select(hashes.valid_hash(F.md5("v")).alias("x"), hashes.valid_hash(F.col("v")).alias("y"))
    assert tuple(hashed.first()) == (hashlib.md5(plain.encode()).hexdigest().upper(), None)
    assert "lambda" not in hashed._jdf.queryExecution().optimizedPlan().toString()
