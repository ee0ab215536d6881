"""Explicit read schemas. Inference would lose the difference between a missing and an unknown field."""

from __future__ import annotations

from pyspark.sql import types as T

_BOOLEANS = ("keyFile", "isHashOnly", "originalKeyFile")
_LONGS = ("minSize", "maxSize")
_INTS = ("osType", "updateStatus")
_STRINGS = (
    "organizationId", "applicationId", "applicationFileId", "hash", "originalHash", "sha256",
    "sha256Hash", "fullPath", "cert", "processPath", "installedBy", "originalFullPath",
    "originalCert", "originalProcessPath", "originalInstalledBy", "notes", "originalNotes",
    "name", "applicationName", "createdBy", "applicationFileDetails", "recordType",
)

RECORD_TYPES = {
    **dict.fromkeys(_STRINGS, T.StringType()),
    **dict.fromkeys(_BOOLEANS, T.BooleanType()),
    **dict.fromkeys(_LONGS, T.LongType()),
    **dict.fromkeys(_INTS, T.IntegerType()),
}
RECORD_FIELDS = T.StructType([T.StructField(n, t) for n, t in RECORD_TYPES.items()])
RECORDS = T.StructType(
    [*RECORD_FIELDS.fields, T.StructField("extras", T.MapType(T.StringType(), T.StringType()))]
)
APPLICATIONS = (
    "applicationId string, organizationId string, name string, osType int, isBuiltIn boolean"
)
GROUPS = ("app string, hash string, survivor string, reason string")
TARGETS = ("app string, fid string, hash string, status string, detail string")
EVENTS = (
    "id long, time double, kind string, app string, fid string, detail string"
)
RULES = (
    "path string, certificate string, process_path string, created_by string, rule_rank long"
)
