"""Record fixtures in the shape snapshots have."""

ORG = "11111111-1111-1111-1111-111111111111"
APP = "22222222-2222-2222-2222-222222222222"
APP2 = "33333333-3333-3333-3333-333333333333"
H = "A" * 64

FIELDS = {
    "applicationFileId": "string", "applicationId": "string", "organizationId": "string", "hash": "string",
    "originalHash": "string", "sha256": "string", "fullPath": "string", "cert": "string",
    "processPath": "string", "installedBy": "string", "originalFullPath": "string", "keyFile": "boolean",
    "isHashOnly": "boolean", "minSize": "bigint", "maxSize": "bigint", "osType": "int", "notes": "string",
    "name": "string", "recordType": "string", "extras": "map<string,string>",
}
SCHEMA = ", ".join(f"{n} {t}" for n, t in FIELDS.items())


def record(fid, hash_=H, app=APP, **kw):
    base = dict.fromkeys(FIELDS)
    base.update(
        applicationFileId=str(fid), applicationId=app, organizationId=ORG, hash=hash_, fullPath="", cert="",
        processPath="", installedBy="", keyFile=False, isHashOnly=True, notes=f"note {fid}", extras={},
    )
    base.update(kw)
    return base


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in FIELDS) for r in rows], SCHEMA)


def applications(spark, *ids, os_type=1):
    return spark.createDataFrame(
        [(a, ORG, "Identical name", os_type, False) for a in ids],
        "applicationId string, organizationId string, name string, osType int, isBuiltIn boolean",
    )


def candidates(spark, *pairs):
    return spark.createDataFrame([(ORG, a, h) for a, h in pairs], "org string, app string, hash_key string")


def source(i, **kw):
    """Observation record: versions of one agent started by one launcher."""
    note = (
        rf"Path: C:\Program Files\Codex Fixture\App\1.2.{i}\agent.exe" + "\n"
        + r"Process: C:\Program Files\Codex Fixture\launcher.exe"
    )
    return record(i, f"{i:064X}", **{"notes": note, **kw})
