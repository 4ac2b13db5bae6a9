"""Source checks that need call arguments, function bodies or several facts of one file."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.calls import BODY_SCHEMA, CALL_SCHEMA, body_batches, call_batches
from sightline.functions.canonical import finding_identity
from sightline.functions.spans import clean_mark, matches_with_offsets
from sightline.functions.text import has_comments, identifier_words, without_comments
from sightline.operators.detect import APPLE_SUFFIXES, Rule, scan

ANDROID_SUFFIXES = (".kt", ".java")
# Words that name security values, and words that make a name a quantity.
SECURITY_WORDS = ("token", "nonce", "salt", "otp", "secret", "password", "passcode", "pin", "iv")
QUANTITY_WORDS = ("length", "len", "size", "count", "index", "idx", "max", "min", "attempts", "retries", "timeout")
ASSIGNMENT = r"(?<!\w)([A-Za-z_]\w{0,63})\s*(?::\s*[\w<>?.]{1,60}\s*)?=(?!=)"
WEAK_RANDOM = (
    r"(?<!\w)Random\s*\(|\bMath\.random\s*\(|(?<!\w)Random\.(?:Default|next[A-Z]\w{0,20})\b"
    r"|\bThreadLocalRandom\.current\s*\("
)
WEAK_RANDOM_APPLE = (
    r"(?<![\w.])(?:rand|random|drand48|lrand48|mrand48)\s*\(\s*\)"
    r"|\bGK(?:MersenneTwister|LinearCongruential|ARC4)RandomSource\b|\bGKRandomSource\b"
)
# Required-reason interface categories and the symbols that show their use.
REQUIRED_REASON = (
    (
        "NSPrivacyAccessedAPICategoryFileTimestamp",
        r"\b(?:creationDate|modificationDate|fileModificationDate|contentModificationDateKey|creationDateKey"
        r"|getattrlist(?:bulk|at)?|fgetattrlist)\b|\b(?:f|l)?stat(?:at)?\s*\(",
    ),
    ("NSPrivacyAccessedAPICategorySystemBootTime", r"\b(?:systemUptime|mach_absolute_time)\b"),
    (
        "NSPrivacyAccessedAPICategoryDiskSpace",
        r"\b(?:volumeAvailableCapacity(?:ForImportantUsage|ForOpportunisticUsage)?Key|volumeTotalCapacityKey"
        r"|systemFreeSize|systemSize)\b|\bf?statv?fs\s*\(",
    ),
    ("NSPrivacyAccessedAPICategoryActiveKeyboards", r"\bactiveInputModes\b"),
    ("NSPrivacyAccessedAPICategoryUserDefaults", r"\b(?:NS)?UserDefaults\b"),
)
# Authentication call shapes.
APPLE_AUTH_BINDING = (
    r"\bkSecAttrAccessControl\b|\bSecAccessControlCreateWithFlags\b|\bkSecUseAuthenticationContext\b"
    r"|\bevaluateAccessControl\b"
)
APPLE_FALLBACK_POLICY = (
    r"\bevaluatePolicy\s*\(\s*(?:LAPolicy)?\.deviceOwnerAuthentication\b"
    r"|\bevaluatePolicy\s*:\s*LAPolicyDeviceOwnerAuthentication\b"
)
APPLE_FALLBACK_FLAGS = r"(?<!\w)\.(?:userPresence|devicePasscode)\b|\bkSecAccessControl(?:UserPresence|DevicePasscode)\b"
APPLE_ENROLLMENT = r"(?<!\w)\.(?:biometryAny|touchIDAny)\b|\bkSecAccessControl(?:BiometryAny|TouchIDAny)\b"
ANDROID_FALLBACK = r"\bsetDeviceCredentialAllowed\s*\(\s*true\b"
ANDROID_AUTH_REQUIRED = r"\bsetUserAuthenticationRequired\s*\(\s*true\b"
ANDROID_AUTH_WINDOW = (
    r"\bsetUserAuthenticationParameters\s*\(\s*[1-9]|\bsetUserAuthenticationValidityDurationSeconds\s*\(\s*[1-9]"
)
ANDROID_FALLBACK_ARGUMENTS = {
    "setAllowedAuthenticators": "DEVICE_CREDENTIAL",
    "setUserAuthenticationParameters": "AUTH_DEVICE_CREDENTIAL",
}
ANDROID_ENROLLMENT = r"\bsetInvalidatedByBiometricEnrollment\s*\(\s*false\b"
FILE_ACCESS_KEY = (
    r"\bsetValue\s*(?:\(\s*true\s*,\s*forKey\s*:\s*|:\s*@\(?\s*(?:YES|true|1)\s*\)?\s+forKey\s*:\s*@)"
    r'"(?:allowFileAccessFromFileURLs|allowUniversalAccessFromFileURLs)"'
)
READ_ACCESS_ARGUMENT = r"\ballowingReadAccessTo(?:URL)?\s*:\s*([^,\n)\]]{0,300}(?:\([^)\n]{0,200}\)[^,\n)\]]{0,100}){0,4})"
BROAD_DIRECTORY = (
    r"\b(?:documentDirectory|libraryDirectory|applicationSupportDirectory|cachesDirectory|NSDocumentDirectory"
    r"|NSLibraryDirectory|NSApplicationSupportDirectory|NSCachesDirectory|NSHomeDirectory"
    r"|homeDirectoryForCurrentUser|NSTemporaryDirectory|temporaryDirectory)\b"
    r'|\bfileURLWithPath\s*:\s*@?"/"'
)
NARROWED = r"\bappendingPathComponent\b|\bappending\s*\(|\bURLByAppendingPathComponent\b"
NON_RELEASE_SOURCE_SET = (
    r"(?:^|/)src/(?:[^/]*[Dd]ebug[^/]*|test(?:[A-Z0-9]\w*)?|androidTest\w*|[a-z]\w*Test(?:[A-Z]\w*)?)/"
)


def with_cleaned(sources: DataFrame) -> DataFrame:
    """``text`` without comments; only files that hold comments are sent to Python."""
    text, suffix = F.col("text"), F.col("suffix")
    blanked = without_comments(F.when(has_comments(text, suffix), text), suffix)
    return sources.withColumn("text", F.coalesce(blanked, text))


def calls(sources: DataFrame, pattern: str, screen: str | None = None) -> DataFrame:
    """Call sites with receiver, declared receiver type and argument texts.

    ``pattern`` (common to Java and Python) ends with the opening bracket; files without it stay in the JVM.
    """
    kept = sources.where(F.col("text").rlike(screen or pattern)).select("app_id", "path", "suffix", "text")
    return kept.mapInPandas(partial(call_batches, pattern=pattern), CALL_SCHEMA)


def sensitive_log_calls(sources: DataFrame, rule: Rule) -> DataFrame:
    """Log calls whose own arguments hold a sensitive word; unclosed calls are kept and marked uncertain."""
    argument = f"(?i){rule.argument_pattern}"
    kept = sources.where(F.col("suffix").isin(*rule.suffixes)) if rule.suffixes else sources
    kept = kept.where(F.col("text").rlike(argument))
    found = calls(kept, rule.java_pattern, rule.java_pattern).where(F.col("argument_text").rlike(argument))
    evidence = F.array(
        F.struct(F.col("line").alias("line"), F.col("byte_offset").alias("offset"), F.col("path").alias("path"))
    )
    return found.select(
        "app_id", "path", F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"),
        F.lit("candidate").alias("status"), "line", F.col("byte_offset").alias("offset"), "call",
        (~F.col("closed")).alias("uncertain"),
        finding_identity(F.lit(rule.rule_id), evidence, ("line", "offset", "path")).alias("id"),
    )


def insecure_random(sources: DataFrame) -> DataFrame:
    """Non-cryptographic generators assigned to security-named variables, within one statement."""
    apple = F.col("suffix").isin(*APPLE_SUFFIXES)
    kept = sources.where(
        F.col("suffix").isin(*ANDROID_SUFFIXES, *APPLE_SUFFIXES) & F.col("text").rlike("rand|Random")
    )
    cleaned = with_cleaned(kept).withColumn("text", clean_mark(F.col("text")))

    # The statement is read ahead to its first generator, however far, so a later assignment in it is seen as well.
    def assigned(generator: str) -> Column:
        pattern = ASSIGNMENT + rf"(?=([^\n;]*?(?:{generator})))"
        return F.arrays_zip(
            matches_with_offsets(F.col("text"), pattern, 1).alias("m"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("tail"),
        )

    found = F.when(apple, assigned(WEAK_RANDOM_APPLE)).otherwise(assigned(WEAK_RANDOM))
    rows = cleaned.select("app_id", "path", apple.alias("apple"), F.explode(found).alias("a"))
    words = identifier_words(F.col("variable"))
    generator = F.when(F.col("apple"), F.regexp_extract("tail", WEAK_RANDOM_APPLE, 0)).otherwise(
        F.regexp_extract("tail", WEAK_RANDOM, 0)
    )
    named = F.arrays_overlap(F.col("words"), F.array(*[F.lit(w) for w in SECURITY_WORDS])) | F.array_join(
        "words", " "
    ).rlike(r"(?:^| )session id(?: |$)")
    return (
        rows.select(
            "app_id", "path", "apple", F.col("a.m.value").alias("variable"), F.col("a.m.line").alias("line"),
            F.col("a.m.offset").alias("offset"), F.col("a.tail").alias("tail"),
        )
        .withColumn("words", words)
        .withColumn("generator", F.regexp_replace(generator, r"[() ]+$", ""))
        .where(named & ~F.coalesce(F.get("words", F.size("words") - 1), F.lit("")).isin(*QUANTITY_WORDS) & (F.col("generator") != ""))
        .select(
            "app_id", "path", F.lit("SOURCE-INSECURE-RANDOM").alias("rule_id"), F.lit("medium").alias("severity"),
            "line", "offset", "variable", "generator",
        )
    )


def undeclared_required_reasons(sources: DataFrame, declared: DataFrame) -> DataFrame:
    """First use per app and category of required-reason interfaces that no manifest declares."""
    rules = [Rule(c, p, suffixes=APPLE_SUFFIXES, case_sensitive=True, once_per_file=True) for c, p in REQUIRED_REASON]
    uses = scan(sources, rules).groupBy("app_id", F.col("rule_id").alias("category")).agg(
        F.min(F.struct("path", "line")).alias("first"), F.count(F.lit(1)).alias("files")
    )
    return uses.join(declared.select("app_id", "category").distinct(), ["app_id", "category"], "left_anti").select(
        "app_id", "category", F.col("first.path").alias("path"), F.col("first.line").alias("line"), "files"
    )


def accepted_server_trust(sources: DataFrame) -> DataFrame:
    """Swift functions that use the presented trust and never evaluate it."""
    kept = sources.where((F.col("suffix") == ".swift") & F.contains("text", F.lit("URLCredential")))
    bodies = kept.select("app_id", "path", "text").mapInPandas(body_batches, BODY_SCHEMA)
    use = r"\.useCredential\s*,\s*URLCredential\s*\(\s*trust\s*:"
    at = F.regexp_instr("body", F.lit(use))
    lines = F.length(F.substr("body", F.lit(1), at)) - F.length(F.replace(F.substr("body", F.lit(1), at), F.lit("\n"), F.lit("")))
    return bodies.where(
        F.col("body").rlike(use) & ~F.col("body").rlike(r"\bSecTrustEvaluate(?:WithError|AsyncWithError)?\s*\(")
    ).select(
        "app_id", "path", F.lit("SWIFT-SERVER-TRUST-ACCEPTED").alias("rule_id"), F.lit("high").alias("severity"),
        "function", (F.col("line") + lines).alias("line"),
    )


def event_bound_authentication(sources: DataFrame) -> DataFrame:
    """Authentication results used as plain events: no crypto object, no bound key in the file."""
    android = sources.where(
        F.col("suffix").isin(*ANDROID_SUFFIXES)
        & ~(F.col("text").rlike(ANDROID_AUTH_REQUIRED) & F.col("text").rlike(ANDROID_AUTH_WINDOW))
    )
    prompts = calls(android, r"\.\s*authenticate\s*\(")
    first = F.coalesce(F.get("args", F.lit(0)), F.lit(""))
    bare = (F.col("receiver_type").startswith("BiometricPrompt") & F.size("args").isin(1, 3)) | (
        F.col("receiver_type").startswith("FingerprintManager") & (first == "null")
    )
    a = prompts.where(bare).select("app_id", "path", "line", F.col("receiver_type").alias("api"))
    apple = sources.where(F.col("suffix").isin(*APPLE_SUFFIXES) & ~F.col("text").rlike(APPLE_AUTH_BINDING))
    b = scan(
        apple,
        [Rule("SOURCE-BIOMETRIC-EVENT-BOUND", r"(?<!func )\bevaluatePolicy\s*[(:]", suffixes=APPLE_SUFFIXES, case_sensitive=True)],
    ).select("app_id", "path", "line", F.lit("LAContext").alias("api"))
    return a.unionByName(b).withColumn("rule_id", F.lit("SOURCE-BIOMETRIC-EVENT-BOUND"))


def credential_fallback(sources: DataFrame) -> DataFrame:
    """Authentication that also accepts the device credential."""
    rules = [
        Rule("SOURCE-BIOMETRIC-FALLBACK", ANDROID_FALLBACK, suffixes=ANDROID_SUFFIXES, case_sensitive=True),
        Rule("SOURCE-BIOMETRIC-FALLBACK", APPLE_FALLBACK_POLICY, suffixes=APPLE_SUFFIXES, case_sensitive=True),
        Rule(
            "SOURCE-BIOMETRIC-FALLBACK", APPLE_FALLBACK_FLAGS, suffixes=APPLE_SUFFIXES, case_sensitive=True,
            requires="SecAccessControl",
        ),
    ]
    literal = scan(sources, rules).select("app_id", "path", "line", F.lit("pattern").alias("basis"))
    named = calls(
        sources.where(F.col("suffix").isin(*ANDROID_SUFFIXES)),
        r"\b(?:" + "|".join(ANDROID_FALLBACK_ARGUMENTS) + r")\s*\(",
    )
    allowed = F.lit(False)
    for method, token in ANDROID_FALLBACK_ARGUMENTS.items():
        allowed = allowed | (
            (F.col("call") == method) & F.array_join("args", "\n").rlike(rf"\b{token}\b")
        )
    by_argument = named.where(allowed).select("app_id", "path", "line", F.col("call").alias("basis"))
    return literal.unionByName(by_argument).withColumn("rule_id", F.lit("SOURCE-BIOMETRIC-FALLBACK"))


def enrollment_survivors(sources: DataFrame) -> DataFrame:
    """Keys kept valid after a new biometric enrollment."""
    rule = "SOURCE-BIOMETRIC-ENROLLMENT"
    return scan(
        sources,
        [
            Rule(rule, ANDROID_ENROLLMENT, suffixes=ANDROID_SUFFIXES, case_sensitive=True),
            Rule(rule, APPLE_ENROLLMENT, suffixes=APPLE_SUFFIXES, case_sensitive=True, requires="SecAccessControl"),
        ],
    ).select("app_id", "path", "line", "rule_id")


def webview_file_access(sources: DataFrame) -> DataFrame:
    """File-URL preferences switched on, and read access granted to a whole app directory.

    A variable passed as the directory is resolved by joining the assignments of the same file.
    """
    apple = sources.where(F.col("suffix").isin(*APPLE_SUFFIXES) & F.contains("text", F.lit("allow")))
    keys = scan(apple, [Rule("K", FILE_ACCESS_KEY, suffixes=APPLE_SUFFIXES, case_sensitive=True)]).select(
        "app_id", "path", "line", F.lit("high").alias("severity"), F.lit("preference").alias("basis")
    )
    readers = with_cleaned(apple.where(F.contains("text", F.lit("allowingReadAccessTo")))).withColumn(
        "text", clean_mark(F.col("text"))
    )
    grants = readers.select(
        "app_id", "path", F.explode(matches_with_offsets(F.col("text"), READ_ACCESS_ARGUMENT, 1)).alias("g")
    ).select("app_id", "path", F.col("g.line").alias("line"), F.trim("g.value").alias("argument"))
    name = F.regexp_extract("argument", r"^(?:(?:self|Self|\w+)\.)?(\w+)!?$", 1)
    assigned_pattern = r"(?<![\w.])(\w+)\b\s*(?::[^=\n]+)?=(?!=)\s*([^\n;]+)"
    assigned = readers.select(
        "app_id", "path",
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all("text", F.lit(assigned_pattern), F.lit(1)).alias("n"),
                F.regexp_extract_all("text", F.lit(assigned_pattern), F.lit(2)).alias("v"),
            )
        ).alias("x"),
    ).select("app_id", "path", F.col("x.n").alias("name"), F.col("x.v").alias("assigned"))
    grants = grants.withColumn("name", name)
    wanted = assigned.join(grants.where("name <> ''").select("app_id", "path", "name").distinct(), ["app_id", "path", "name"])
    resolved = grants.join(wanted, ["app_id", "path", "name"], "left").select(
        "app_id", "path", "line",
        F.explode(F.array_distinct(F.array_compact(F.array("argument", "assigned")))).alias("value"),
    )
    broad = F.regexp_extract("value", BROAD_DIRECTORY, 0)
    after = F.substr("value", F.regexp_instr("value", F.lit(BROAD_DIRECTORY)) + F.length(broad))
    home = broad.isin("NSHomeDirectory", "homeDirectoryForCurrentUser")
    standard = after.rlike(
        r'(?:appendingPathComponent|appending\s*\(\s*(?:path|component)\s*:)\s*\(?\s*@?"(?:Documents|Library'
        r'|tmp|Library/Caches|Library/Application Support)/?"'
    )
    wide = resolved.where((broad != "") & (~after.rlike(NARROWED) | (home & standard))).select(
        "app_id", "path", "line", F.lit("medium").alias("severity"), F.lit("directory").alias("basis")
    ).distinct()
    return keys.unionByName(wide).withColumn("rule_id", F.lit("IOS-WEBVIEW-FILE-ACCESS"))


def release_sources(sources: DataFrame) -> DataFrame:
    """Files outside debug and test source sets."""
    return sources.where(~F.col("path").rlike(NON_RELEASE_SOURCE_SET))


