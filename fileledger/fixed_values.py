"""Fixed values.

Word lists, lookup tables, patterns and message texts that the results depend
on. They are data, not logic: changing one changes what the library reports.
Patterns use Java regex syntax because Spark evaluates them.
"""

# --- record model ----------------------------------------------------------

# Fields with a defined meaning. Any other populated field makes a record's
# matching semantics unknown, so its whole group is preserved.
KNOWN_FIELDS = [
    "hash", "fullPath", "cert", "processPath", "installedBy", "keyFile", "isHashOnly",
    "minSize", "maxSize", "notes", "applicationFileId", "applicationId", "applicationName",
    "organizationId", "osType", "name", "createdBy", "applicationFileDetails",
    "originalFullPath", "originalCert", "originalHash", "originalProcessPath",
    "originalNotes", "originalInstalledBy", "originalKeyFile", "updateStatus",
    "sha256", "sha256Hash", "recordType",
]

# Columns that the record view and the readers add; they say nothing about what a record matches.
DERIVED_FIELDS = ["extras", "org", "app", "fid", "id_num", "hash_key", "plain", "fingerprint", "application_os"]

OS_NAMES = {1: "Windows", 2: "macOS"}

REASON_NO_DUPLICATES = "No current duplicates"
REASON_AMBIGUOUS = "Ambiguous matching fields or key-file/type flag; entire group preserved"
REASON_SURVIVOR = "Lowest numeric applicationFileId retained; notes archived"
UNNAMED_APPLICATION = "Unnamed application"

# Outcome states of a planned removal.
PLANNED = "Planned"
DISPATCHED = "Dispatched"
ACCEPTED = "Accepted"
UNCERTAIN = "Uncertain"
STILL_PRESENT = "StillPresent"
VERIFIED_ABSENT = "VerifiedAbsent"
RESPONSE_EVENT = "DeleteResponse"
UNKNOWN_STATUS = "Unknown"

MAX_WAVE_SIZE = 32

# Legacy request lists spell one record type in several ways.
RECORD_TYPE_ALIASES = {"SHA256": "SHA256ONLY", "SHA-256": "SHA256ONLY"}

# --- observation columns ---------------------------------------------------

COLUMN_ALIASES = {
    "full path": "path",
    "path": "path",
    "process path": "process_path",
    "process": "process_path",
    "created by": "created_by",
    "created by process": "created_by",
    "certificate": "certificate_primary",
    "certificates": "certificate_raw",
    "certificate(s)": "certificate_raw",
    "hash": "md5_or_sha256",
    "sha256": "sha256_hash",
    "notes": "notes",
    "host name": "hostname",
    "hostname": "hostname",
    "date/time": "timestamp_utc",
    "count": "count",
}

# --- note labels -----------------------------------------------------------

NULL_WORDS = r"nan|none|\[\]|\{\}"

# Spellings of each label kind; the alternation of all of them is the splitter.
LABELS = {
    "hostname": r"Hostname:|Host:|Computer:|Device:|Machine:",
    "sha256_hash": r"SHA256:",
    "hash": r"Hash:",
    "path": r"Path:",
    "process_path": r"Process(?: Name| Path)?:|Image:|File:|Binary:",
    "certificate_raw": r"Cert(?:ificate|ificates)?s?:|Publisher:|Thumbprint:",
    "created_by": r"Created By:",
    "added_by": r"Added by [^:]+:",
}

TIMESTAMP = r"(?i)\b(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?\s*UTC?)\b"
TRAILING_REPEAT = r"(?i)\s+RE\(\d+\)\s*$"
# A run of path characters, then more runs after single separators. The
# possessive repeat keeps Java from recursing once per segment.
WINDOWS_PATH = r'(?i)([a-z]:\\[^\\/:*?"<>|\r\n]+(?:\\[^\\/:*?"<>|\r\n]+)*+)'
POSIX_PATH = r"(/[^/\r\n]+(?:/[^/\r\n]+)*+)"
CERT_CN = r"(?i)\b(cn\s*=\s*[^;|\r\n]+)"
HASH64 = r"\b([A-Fa-f0-9]{64})\b"
HASH40 = r"\b([A-Fa-f0-9]{40})\b"
HASH32 = r"\b([A-Fa-f0-9]{32})\b"
PATH_LABEL_COUNT = r"(?i)(?<!process )\bpath\s*:"

INLINE_FIELD = (
    r"(?i)\s+(?:process|processpath|process path|installedby|installed by|createdby"
    r"|created by|cert|certificate)=.*$"
)
INLINE_ADDED_BY = r"(?i)\s+added\s+by:\s*([^\r\n]+?)\s*$"
INLINE_MERGED_BY = r"(?i)\s+merged\s+by:\s*([^\r\n]+?)\s+\d{4}-\d{2}-\d{2}.*$"
EMBEDDED_LABEL_TAIL = (
    r"(?is)\s+(?:Path|Process(?: Path)?|Certificate|Cert|Created By|Hash|Hostname):.*$"
)

# --- certificates ----------------------------------------------------------

CERT_ORGANIZATION = r"(?:^|[,;|]\s*)o\s*=\s*([^,;|]+)"
CERT_COMMON_NAME = r"(?:^|[,;|]\s*)cn\s*=\s*([^,;|]+)"
CERT_VENDORS = {
    "developer express incorporated": "developer express",
    "developer express inc.": "developer express",
    "developer express inc": "developer express",
    "autodesk, inc.": "autodesk",
    "autodesk inc.": "autodesk",
    "autodesk inc": "autodesk",
    "portswigger ltd": "portswigger",
    "google llc": "google llc",
    "microsoft corporation": "microsoft corporation",
    "3dconnexion s.a.m.": "3dconnexion s.a.m.",
    "3dconnexion s.a.m": "3dconnexion s.a.m.",
}
GENERIC_SIGNER = "microsoft corporation"

# --- path vocabulary -------------------------------------------------------

INSTALLER_EXTENSIONS = ["msi", "msp", "msix", "msixbundle", "appx", "appxbundle"]
FAMILY_EXTENSIONS = [".dll", ".exe", ".sys", ".jar"]
PROGRAM_FILES = ["program files", "program files (x86)"]
LANGUAGE_FOLDERS = [
    "en-us", "en-gb", "en", "fr-fr", "fr", "de-de", "de", "es-es", "es", "it-it", "it",
    "ja-jp", "ja", "ko-kr", "ko", "pt-br", "pt", "ru-ru", "ru", "zh-cn", "zh-tw",
    "zh-hans", "zh-hant", "cs-cz", "cs", "hu-hu", "hu", "pl-pl", "pl", "tr-tr", "tr",
    "nl-nl", "nl", "sv-se", "sv", "da-dk", "da", "fi-fi", "fi", "nb-no", "no",
]
SEGMENT_VERSION = r"v?\d+(?:\.\d+){1,8}"
SEGMENT_RELEASE = r"r\d{1,3}"
SEGMENT_YEAR = r"20\d{2}"
SEGMENT_GUID = r"\{?[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}\}?"
SEGMENT_LONG_NUMBER = r"\d{10,}"
SEGMENT_LONG_HEX = r"[a-f0-9]{16,64}"
SEGMENT_HEX = r"[a-f0-9]{8,64}"
SEGMENT_MIXED = r"(?=[a-z0-9]*[a-z])(?=[a-z0-9]*\d)[a-z0-9]{6,12}"
SEGMENT_TMP = r"\.tmp(?:-\d+)?"
VOLATILE_MARK = "<VOLATILE>"

# Share of distinct values above which a non-volatile position is wildcarded.
# Presets of rule mining. Narrow keeps user profiles, versions, whole paths and siblings apart;
# broad adds pairs with creators and merges siblings to their heads.
PROFILES = {
    "conservative": {"levels": 4, "narrow": True, "broad": False},
    "balanced": {"levels": 3, "narrow": False, "broad": False},
    "aggressive": {"levels": 2, "narrow": False, "broad": True},
}
CONSOLIDATION_LEVELS = 4
LEAST_LEVELS = 2
MOST_WILDCARDS = 2
EXAMPLE_PATHS = 5
RISKY_PROCESS_CONDITIONS = 3
FAMILY_MEMBERS = 3
FAMILY_STRENGTHS = ["off", "conservative", "balanced", "aggressive"]
DISTINCT_SHARE = {"aggressive": 0.65, "balanced": 0.80}

# --- macOS clean-up --------------------------------------------------------

MAC_TRANSLOCATION = (
    r"(?i)^/private/var/folders/[^/]+/[^/]+/t/apptranslocation/\*/d/(.+?\.app/contents/.+)$"
)
MAC_VSCODE_VERSION = r"(?i)(/users/\*/\.vscode/extensions/[^/]+?)-\d+(?:\.\d+)*(?:-[^/]*)?/"
MAC_HOMEBREW_CELLAR = r"(?i)(/opt/homebrew/cellar/[^/]+)/[^/]+/"
MAC_HOMEBREW_RUBY = r"(?i)(/usr/local/homebrew/[^ ]*?/portable-ruby)/[^/]+/"
MAC_PYTHON_FRAMEWORK = r"(?i)(/library/frameworks/python\.framework/versions)/[^/]+/"
MAC_APP_BUNDLE = r"(?i)^(.+?\.app)(?:/contents/.*)?$"
MAC_SITE_PACKAGES = (
    r"(?i)^/users/([^/]+)/library/python/([^/]+)/lib/python/site-packages/([^/]+)(?:/.*)?$"
)
MAC_SITE_PACKAGE_RULE = (
    r"(?i)^/users/\*/library/python/\*/lib/python/site-packages/([^/]+)/\*$"
)
MAC_BROAD_PATHS = (
    r"(?i)^(?:/applications/\*/\*/?|/users/\*/library/\*|/users/\*/library/python/\*"
    r"|/users/\*/\.pyenv/\*)$"
)
MAC_INVALID_PROCESSES = ["*", "/*", "/applications/*", "/applications/*/*"]
MAC_PRIVATE_FRAMEWORK = (
    r"(?i)^/system/(?:volumes/preboot/cryptexes/os/system/)?library/privateframeworks/"
)
MAC_USER_WRITABLE = ["/users/", "/private/var/", "/var/folders/", "/tmp/", "/var/tmp/"]
MAC_HIGH_RISK_DIRECTORIES = ["/private/var/", "/var/folders/", "/tmp/", "/users/"]
MAC_PYTHON_MARKERS = [
    "/.venv/", "/venv/", "/site-packages/", "/lib/python", "/miniconda", "/anaconda",
    "/.pyenv/versions/", "/.local/share/uv/python/", "/uv/python/",
]
MAC_NATIVE_LEAF = r"(?:\.so|\.dylib|\.pyd|\.a|/\*)$"
PYTHON_BASENAME = r"python(?:\d+(?:\.\d+)*)?"
PYTHON_APP = "/python.app/contents/macos/python"

# --- risk vocabulary -------------------------------------------------------

HIGH_RISK_BASENAMES = [
    "msiexec.exe", "explorer.exe", "cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe",
    "cscript.exe", "rundll32.exe", "regsvr32.exe", "mshta.exe", "wmic.exe", "wmiprvse.exe",
    "schtasks.exe", "certutil.exe", "bitsadmin.exe", "installutil.exe", "msbuild.exe",
    "reg.exe", "sc.exe", "net.exe", "net1.exe", "whoami.exe", "forfiles.exe", "hh.exe",
    "control.exe", "odbcconf.exe", "msxsl.exe", "curl.exe", "wget.exe", "ftp.exe",
    "atbroker.exe", "cmstp.exe", "dnscmd.exe", "esentutl.exe", "expand.exe", "makecab.exe",
    "mavinject.exe", "msconfig.exe", "presentationhost.exe", "syncappvpublishingserver.exe",
    "verclsid.exe", "msdt.exe", "conhost.exe", "dllhost.exe", "svchost.exe",
    "taskhostw.exe", "werfault.exe", "java.exe", "javaw.exe", "python.exe", "pythonw.exe",
    "node.exe", "perl.exe", "ruby.exe", "bash.exe",
]
HIGH_RISK_DIRECTORIES = (
    r"\\windows\\|\\appdata\\local\\temp\\|\\appdata\\roaming\\|\\programdata\\"
)
HIGH_RISK_EXTENSIONS = r"\.(?:exe|bat|cmd|ps1|vbs|js)[\\/]*$"
MAC_HIGH_RISK_BASENAMES = [
    "bash", "zsh", "sh", "osascript", "python", "python3", "ruby", "perl", "node", "npm",
    "curl", "wget", "installer", "pkgutil", "launchctl", "sudo", "su", "chmod", "chown",
    "xattr", "codesign", "spctl", "tccutil", "plutil", "defaults", "open",
]
USER_WRITABLE = ["c:\\users\\", "c:\\windows\\temp\\", "c:\\temp\\", "c:\\programdata\\"]
# A bare wildcard, or one of all libraries or programs, anywhere below the profiles.
DANGEROUS_USER_PATHS = r"^c:\\users\\(?:.*\\)?\*(?:\.dll|\.exe)?$"
RISK_HIGH = 12
RISK_MEDIUM = 6

NOTE_INVALID_PROCESS = "Invalid wildcard process path"
NOTE_BROAD_MAC = "Overbroad macOS wildcard path"
NOTE_PRIVATE_FRAMEWORK = "Apple private framework helper requires extra anchor"
NOTE_HIGH_RISK = "High-risk process path requires 3 conditions"

# --- rule mining -----------------------------------------------------------

PAIR_TYPES = {
    "ProcessPath": ("Process Path", "Path"),
    "ProcessCert": ("Process Path", "Certificate"),
    "PathCert": ("Path", "Certificate"),
    "PathCreatedBy": ("Path", "Created By"),
    "ProcessCreatedBy": ("Process Path", "Created By"),
}
MERGED_RULE_TYPE = "MergedPathGroup"

REJECT_CONDITIONS = "Requires path plus another condition"
REJECT_SYNTAX = "Unsupported matching syntax"
REJECT_ANCHORS = "Identity anchors must be exact"
REJECT_LOCATION = "Live consolidation limited to Windows Program Files paths"
REJECT_BROAD = "Path is too broad"
REJECT_HIGH_RISK = "High-risk process needs three conditions"
REJECT_COVERAGE = "Fewer than two additional source records covered"
REJECT_MACOS = "macOS candidate application is not yet live validated"
REVIEW_REASON = "Expands beyond exact hashes; review conditions before applying"
STATUS_REJECTED = "Preserved / review"
STATUS_REVIEW = "Review required"

# Messages of the checks that compare snapshots, plans and requests.
MESSAGE_NEW = "New application records detected; existing plan cannot proceed."
MESSAGE_CHANGED = "Record fields changed; existing plan cannot proceed."
MESSAGE_MISSING_UNPLANNED = "Retained or unrelated record disappeared; cleanup stopped."
MESSAGE_MISSING_PLANNED = "Unsubmitted target disappeared; external change detected."
MESSAGE_REAPPEARED = "Previously absent record reappeared; stopped."
MESSAGE_METADATA = "Application metadata changed; build a new plan."
MESSAGE_RULE_MISSING = "Inserted rule missing or ambiguous."
MESSAGE_RULE_SEMANTICS = "Inserted rule has unexpected matching semantics."
MESSAGE_RULE_ORIGINALS = "Inserted rule original fields disagree with the reviewed conditions."
MESSAGE_RULE_CHANGED = "Inserted rule changed."
MESSAGE_TARGET_CHANGED = "Saved target changed hash or rule type; recovery blocked."
MESSAGE_CANDIDATE_ORGANIZATION = "Candidate organization mismatch."
MESSAGE_IDENTITY = "Invalid organization or application ID."
MESSAGE_HASH = "Invalid report hash; expected 32, 40 or 64 hexadecimal characters."
