"""Detection rules: a predicate over one telemetry row, with a likelihood pair.

A row meets only the rules of its kind, as an array of structs that is
exploded. Kinds go in passes of a few rules each: the filter on the kind
reaches the scan, and no pass outgrows a generated method. The rows' facts (tracked parent, novelty, siblings) come from ``operators.facts``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telarium.functions.scalars import base_name, command_image, contains_any, ends_with_any, is_routable, stem

# The lists that the rules compare with.
INTERPRETERS = ("cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "certutil.exe", "bitsadmin.exe")
HOST_APPS = ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "msaccess.exe", "acrord32.exe", "chrome.exe", "firefox.exe", "msedge.exe")
SYSTEM_NAMES = ("svchost", "lsass", "csrss", "winlogon", "services", "smss", "wininit", "explorer", "taskhostw", "spoolsv", "dllhost")
LOLBINS = ("certutil", "bitsadmin", "regsvr32", "rundll32", "mshta", "wmic", "msbuild", "installutil", "regasm", "regsvcs")
TLDS = (".top", ".xyz", ".tk", ".ml", ".ga", ".cf", ".gq", ".work", ".click", ".zip")
WRITABLE = ("\\temp\\", "\\tmp\\", "\\appdata\\", "\\downloads\\", "\\public\\", "\\programdata\\", "\\users\\")
STAGING = ("\\temp\\", "\\tmp\\", "\\downloads\\", "\\public\\", "\\programdata\\")
RANSOM = (".locked", ".encrypted", ".crypto", ".crypt", ".locky", ".zepto", ".wcry", ".wncry", ".ryuk")
PORTS = (4444, 1337, 31337, 12345, 54321, 6666, 6667, 9001)
CRASHES = (0xC0000005, 0xC000001D, 0xC0000374, 0xC0000409)
EXECUTABLE = (".exe", ".dll", ".scr", ".sys", ".ps1", ".bat", ".cmd", ".vbs", ".vbe", ".js", ".jse", ".hta", ".lnk", ".wsf", ".msi", ".cpl")
FETCH = ("http://", "https://", "urlcache", "/i:http", "ftp://")
RUN_KEYS = ("\\currentversion\\run", "\\currentversion\\runonce", "\\winlogon\\shell", "\\currentversion\\explorer\\shell folders")
ENCODED = ("-encodedcommand", "-enc ", "-e ", "-ec ")
HIDDEN = ("-windowstyle hidden", "-w hidden")
SCRIPT_ENCODED = ("-encodedcommand", "-encodedarguments")
BLOB_MARKERS = ("-enc ", "-enc(", "-ec ", "-en ")
OBFUSCATION = ("frombase64string", "invoke-expression", "iex(", "iex ", "|iex", "[scriptblock]::create", "-bxor", "-join[char", "[char[]]", "[text.encoding]::")
REMOTE = ("downloadstring", "downloaddata", "downloadfile", "net.webclient", "start-bitstransfer", "invoke-webrequest", "invoke-restmethod", "wget ", "curl ")
EVASION = ("amsiutils", "amsiinitfailed", "amsiscanbuffer", "set-mppreference", "add-mppreference", "exclusionpath", "exclusionprocess", "disableantispyware", "disablebehaviormonitoring", "disableioavprotection")
CODE_CONSUMERS = ("commandlineeventconsumer", "activescripteventconsumer")

#: The technique of each rule, in rule order.
TECHNIQUES = {
    "encoded_powershell": "T1059.001",
    "interpreter_from_host_app": "T1059",
    "masquerading_outside_system32": "T1036.005",
    "lolbin_remote_fetch": "T1218",
    "run_key_persistence": "T1547.001",
    "high_abuse_tld": "T1071.004",
    "novel_binary_in_writable_location": "T1036",
    "process_fanout_burst": "T1055",
    "script_block_encoded_command": "T1059.001",
    "script_block_obfuscated": "T1140",
    "script_block_remote_fetch": "T1105",
    "script_block_defence_evasion": "T1562.001",
    "wmi_process_creation": "T1047",
    "wmi_permanent_subscription": "T1546.003",
    "scheduled_task_registered": "T1053.005",
    "unsigned_image_from_writable_location": "T1574.002",
    "executable_dropped_in_writable_location": "T1105",
    "executable_deleted_from_staging_location": "T1070.004",
    "ransomware_extension_on_rename": "T1486",
    "connect_to_implant_default_port": "T1571",
    "large_transfer_to_implant_port": "T1041",
    "exploitation_crash_exit_code": "T1203",
}


@dataclass(frozen=True)
class Rule:
    """``tiers``: (condition or None, hit, miss), the first that holds gives the pair."""

    name: str
    technique: str
    kind: str
    when: Column
    tiers: tuple[tuple[Column | None, float, float], ...]
    title: str
    needs_facts: bool = False

    def pair(self) -> Column:
        """(hit, miss) of the first tier that holds; its tests stand once."""
        clamp = lambda x: F.lit(max(1e-4, min(1.0, float(x))))
        made = [(test, F.struct(clamp(hit).alias("hit"), clamp(miss).alias("miss"))) for test, hit, miss in self.tiers]
        out = made[-1][1]
        for test, pair in reversed(made[:-1]):
            out = F.when(test, pair).otherwise(out)
        return out

    def finding(self, order: int) -> Column:
        fires = F.coalesce(self.when, F.lit(False))
        return F.when(fires, F.struct(F.lit(order).alias("ord"), F.lit(self.name).alias("rule"), F.lit(self.technique).alias("technique"), self.pair().alias("pair"), detail_of(self.name).alias("detail")))


def _holds(column: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{n}')" for n in needles) + ")"


def _first(column: str, needles: tuple[str, ...]) -> str:
    """The first of the needles, in their order, that a text holds."""
    return "CASE " + " ".join(f"WHEN contains(lower({column}), '{n}') THEN '{n}'" for n in needles) + " ELSE '' END"


#: What a finding of each rule tells, as SQL over its event: the sign that was seen, never a whole script.
DETAILS = {
    "encoded_powershell": f"concat('encoded command line', CASE WHEN {_holds('command_line', HIDDEN)} THEN ', window hidden' ELSE ', window shown' END)",
    "interpreter_from_host_app": "concat(coalesce(parent_image, 'unknown'), ' started ', image)",
    "masquerading_outside_system32": "concat(image, ' has the name of a system file')",
    "lolbin_remote_fetch": "concat(image, ' with a remote location')",
    "run_key_persistence": "concat('value set below ', key_path)",
    "high_abuse_tld": "concat('query for ', query_name)",
    "novel_binary_in_writable_location": "concat('first start of ', image)",
    "process_fanout_burst": "concat(cast(siblings AS string), ' children of one parent before it')",
    "script_block_encoded_command": "'script with an encoded command'",
    "script_block_obfuscated": f"concat('script with ', {_first('script_text', OBFUSCATION)})",
    "script_block_remote_fetch": f"concat('script with ', {_first('script_text', REMOTE)})",
    "script_block_defence_evasion": f"concat('script with ', {_first('script_text', EVASION)})",
    "wmi_process_creation": f"concat(CASE WHEN {_holds('command_line', INTERPRETERS)} OR {_holds('command_line', LOLBINS)} THEN 'interpreter or system tool' ELSE 'process' END, CASE WHEN coalesce(is_local = false, false) OR coalesce(client_machine NOT IN ('', '.'), false) THEN ' started from afar: ' ELSE ' started: ' END, {{command}})",
    "wmi_permanent_subscription": f"concat(CASE WHEN {_holds('coalesce(consumer, ' + chr(39) * 2 + ')', CODE_CONSUMERS)} THEN 'subscription that runs code: ' ELSE 'subscription: ' END, coalesce(consumer, 'no consumer'))",
    "scheduled_task_registered": "concat(CASE WHEN contains(lower(task_name), 'microsoft') OR contains(lower(task_name), 'windows') OR contains(lower(task_name), 'defender') THEN 'task with a system name: ' ELSE 'task: ' END, task_name)",
    "unsigned_image_from_writable_location": "concat('unsigned ', path)",
    "executable_dropped_in_writable_location": "concat('written: ', path)",
    "executable_deleted_from_staging_location": "concat('deleted: ', path)",
    "ransomware_extension_on_rename": "concat('renamed to ', new_path)",
    "connect_to_implant_default_port": "concat('port ', cast(destination_port AS string), ' of ', destination_ip)",
    "large_transfer_to_implant_port": "concat(cast(bytes_sent AS string), ' bytes to port ', cast(destination_port AS string), ' of ', destination_ip)",
    "exploitation_crash_exit_code": "concat('exit code ', cast(exit_code AS string))",
}
def detail_of(name: str) -> Column:
    """What a finding tells; the program of a command line by ``command_image``."""
    head, _, tail = DETAILS[name].partition("{command}")
    if not _:
        return F.expr(DETAILS[name])
    return F.concat(F.expr(head.rstrip(", ") + ")"), command_image(F.col("command_line")))


#: Rules that share a pass over the rows of their kinds.
RULES_A_PASS = 4


def _blob(text: Column) -> Column:
    """An encoded blob of 20 or more characters behind the first place of a marker."""
    low, tests = F.lower(text), None
    for marker in BLOB_MARKERS:
        at = F.instr(low, marker)
        rest = F.regexp_extract(F.ltrim(F.substring(low, at + len(marker), F.length(low))), r"^[^\s'\"]*", 0)
        test = (at > 0) & rest.rlike("^[a-z0-9+/=]{20,}$")
        tests = test if tests is None else tests | test
    return tests


def rules() -> list[Rule]:
    """The rules, in the order in which they run. Pairs and titles."""
    c = F.col
    only = lambda hit, miss: ((None, hit, miss),)
    writable = lambda p: contains_any(c(p), WRITABLE)
    spawns = contains_any(c("command_line"), INTERPRETERS) | contains_any(c("command_line"), LOLBINS)
    remote = F.coalesce(c("is_local") == F.lit(False), F.lit(False)) | F.coalesce(~c("client_machine").isin("", "."), F.lit(False))
    port = c("destination_port").isin(*PORTS) & is_routable(c("destination_ip"))
    task = F.lower("task_name")
    return [
        Rule("encoded_powershell", TECHNIQUES["encoded_powershell"], "process_start", base_name(c("image")).isin("powershell.exe", "pwsh.exe") & contains_any(c("command_line"), ENCODED), ((contains_any(c("command_line"), HIDDEN), 0.92, 0.010), (None, 0.72, 0.020)), "Encoded PowerShell command"),
        Rule("interpreter_from_host_app", TECHNIQUES["interpreter_from_host_app"], "process_start", base_name(c("image")).isin(*INTERPRETERS) & base_name(c("parent_image")).isin(*HOST_APPS), only(0.55, 0.040), "Interpreter spawned by a host application", True),
        Rule("masquerading_outside_system32", TECHNIQUES["masquerading_outside_system32"], "process_start", stem(c("image")).isin(*SYSTEM_NAMES) & writable("image"), only(0.88, 0.015), "System binary name outside a system directory"),
        Rule("lolbin_remote_fetch", TECHNIQUES["lolbin_remote_fetch"], "process_start", stem(c("image")).isin(*LOLBINS) & contains_any(c("command_line"), FETCH), only(0.68, 0.025), "Signed binary used against a remote location"),
        Rule("run_key_persistence", TECHNIQUES["run_key_persistence"], "registry_set", contains_any(c("key_path"), RUN_KEYS), only(0.62, 0.008), "Persistence via a Run key"),
        Rule("high_abuse_tld", TECHNIQUES["high_abuse_tld"], "dns_query", ends_with_any(c("query_name"), TLDS), only(0.30, 0.070), "Resolution in a high-abuse namespace"),
        Rule("novel_binary_in_writable_location", TECHNIQUES["novel_binary_in_writable_location"], "process_start", c("image_is_novel") & writable("image"), only(0.45, 0.030), "First sighting of a binary in a writable location", True),
        Rule("process_fanout_burst", TECHNIQUES["process_fanout_burst"], "process_start", c("siblings") >= 8, ((c("siblings") >= 32, 0.50, 0.020), (None, 0.25, 0.060)), "Unusual process fan-out", True),
        Rule("script_block_encoded_command", TECHNIQUES["script_block_encoded_command"], "script_block", contains_any(c("script_text"), SCRIPT_ENCODED) | _blob(c("script_text")), only(0.80, 0.015), "PowerShell script with an encoded command"),
        Rule("script_block_obfuscated", TECHNIQUES["script_block_obfuscated"], "script_block", contains_any(c("script_text"), OBFUSCATION), only(0.55, 0.030), "PowerShell script that decodes itself"),
        Rule("script_block_remote_fetch", TECHNIQUES["script_block_remote_fetch"], "script_block", contains_any(c("script_text"), REMOTE), only(0.45, 0.050), "PowerShell script fetching from the network"),
        Rule("script_block_defence_evasion", TECHNIQUES["script_block_defence_evasion"], "script_block", contains_any(c("script_text"), EVASION), only(0.65, 0.005), "PowerShell script touching the defences"),
        Rule("wmi_process_creation", TECHNIQUES["wmi_process_creation"], "wmi_process", F.lit(True), ((spawns & remote, 0.90, 0.010), (spawns, 0.70, 0.020), (remote, 0.55, 0.015), (None, 0.35, 0.040)), "Process created through WMI"),
        Rule("wmi_permanent_subscription", TECHNIQUES["wmi_permanent_subscription"], "wmi_subscription", F.lit(True), ((contains_any(F.coalesce("consumer", F.lit("")), CODE_CONSUMERS), 0.85, 0.008), (None, 0.45, 0.030)), "Permanent WMI event subscription"),
        Rule("scheduled_task_registered", TECHNIQUES["scheduled_task_registered"], "task_registered", ~task.startswith("\\microsoft\\"), ((task.contains("microsoft") | task.contains("windows") | task.contains("defender"), 0.60, 0.020), (None, 0.40, 0.035)), "Scheduled task registered outside the Windows namespace"),
        Rule("unsigned_image_from_writable_location", TECHNIQUES["unsigned_image_from_writable_location"], "image_load", (c("signed") == F.lit(False)) & writable("path"), only(0.42, 0.030), "Unsigned image loaded from a writable location"),
        Rule("executable_dropped_in_writable_location", TECHNIQUES["executable_dropped_in_writable_location"], "file_create", ends_with_any(c("path"), EXECUTABLE) & writable("path"), only(0.35, 0.040), "Executable written to a writable location"),
        Rule("executable_deleted_from_staging_location", TECHNIQUES["executable_deleted_from_staging_location"], "file_delete", ends_with_any(c("path"), EXECUTABLE) & contains_any(c("path"), STAGING), only(0.30, 0.080), "Executable deleted from a staging directory"),
        Rule("ransomware_extension_on_rename", TECHNIQUES["ransomware_extension_on_rename"], "file_rename", ends_with_any(c("new_path"), RANSOM), only(0.35, 0.020), "File renamed to a ransomware extension"),
        Rule("connect_to_implant_default_port", TECHNIQUES["connect_to_implant_default_port"], "network_connect", port, only(0.40, 0.030), "Connection to an implant's default port"),
        Rule("large_transfer_to_implant_port", TECHNIQUES["large_transfer_to_implant_port"], "network_disconnect", port & (F.coalesce("bytes_sent", F.lit(0)) >= 8 * 1024 * 1024), only(0.30, 0.015), "Large transfer to an implant's default port"),
        Rule("exploitation_crash_exit_code", TECHNIQUES["exploitation_crash_exit_code"], "process_exit", c("exit_code").cast("bigint").bitwiseAND(4294967295).isin(*CRASHES), only(0.15, 0.020), "Process died from an exploitation-class fault"),
    ]


def title_of(rule: Column, more: dict[str, str] | None = None) -> Column:
    """Title of a rule; ``more``: titles of SIGMA rules by id, which come first."""
    titles = {r.name: r.title for r in rules()} | (more or {})
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in titles.items() for x in pair)), rule), F.lit("Suspicious activity"))


def findings(events: DataFrame, chosen: list[Rule] | None = None, keep: tuple[str, ...] = ("id", "host", "us", "pid", "kind")) -> DataFrame:
    """One row for each rule that fires; ``ord`` is its place in the rule order."""
    by_kind: dict[str, list[Column]] = {}
    for i, rule in enumerate(rules() if chosen is None else chosen):
        by_kind.setdefault(rule.kind, []).append(rule.finding(i))
    passes: list[dict[str, list[Column]]] = []
    for kind, found in by_kind.items():
        last = passes[-1] if passes and sum(map(len, passes[-1].values())) + len(found) <= RULES_A_PASS else None
        if last is None:
            passes.append({})
        passes[-1][kind] = found
    out = None
    for kinds in passes:
        fired = F
        for kind, found in kinds.items():
            fired = fired.when(F.col("kind") == kind, F.array(*found))
        rows = events.where(F.col("kind").isin(*kinds)).select(*keep, F.explode(fired).alias("x")).where("x IS NOT NULL").select(*keep, "x.ord", "x.rule", "x.technique", "x.pair.*", "x.detail")
        out = rows if out is None else out.unionAll(rows)
    return out
