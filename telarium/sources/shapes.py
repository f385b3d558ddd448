"""Raw events: which event is which shape, how its fields are spelled, what it must carry."""

from __future__ import annotations

#: Fixed values: (provider, event id, shape, is kernel-side).
SHAPES = (
    ("Microsoft-Windows-Kernel-Process", 1, "process_start", True), ("Microsoft-Windows-Kernel-Process", 2, "process_exit", True), ("Microsoft-Windows-Kernel-Process", 5, "image_load", True),
    ("Microsoft-Windows-Kernel-Registry", 5, "registry_set", True), ("Microsoft-Windows-DNS-Client", 3006, "dns_query", False), ("Microsoft-Windows-PowerShell", 4104, "script_block", False),
    ("Microsoft-Windows-Kernel-File", 12, "file_create", True), ("Microsoft-Windows-Kernel-File", 20, "file_rename", True), ("Microsoft-Windows-Kernel-File", 27, "file_delete", True),
    ("Microsoft-Windows-Kernel-Network", 10, "network_connect", True), ("Microsoft-Windows-Kernel-Network", 11, "network_disconnect", True), ("Microsoft-Windows-Security-Auditing", 4688, "process_start_audit", True),
    ("Microsoft-Windows-WMI-Activity", 23, "wmi_process", False), ("Microsoft-Windows-WMI-Activity", 5861, "wmi_subscription", False), ("Microsoft-Windows-TaskScheduler", 106, "task_registered", False),
)

#: Spellings of each field; the first that is not empty counts.
CHAINS = {
    "process_id": ("ProcessID", "ProcessId", "NewProcessId"),
    "parent_process_id": ("ParentProcessID", "ParentProcessId", "NewParentProcessId"),
    "image_name": ("ImageName", "ImagePath"),
    "key_name": ("KeyName", "KeyPath", "RelativeName"),
    "key_object": ("KeyObject", "KeyObjectPtr"),
    "value_name": ("ValueName", "Value"),
    "captured_data": ("CapturedData",),
    "registry_type": ("Type", "ValueType"),
    "exit_code": ("ExitCode", "ExitStatus"),
    "query_name": ("QueryName",),
    "query_type": ("QueryType",),
    "script_text": ("ScriptBlockText",),
    "script_block_id": ("ScriptBlockId",),
    "script_path": ("Path",),
    "message_number": ("MessageNumber",),
    "message_total": ("MessageTotal",),
    "file_name": ("FileName", "FilePath", "Path"),
    "file_old_name": ("OldFileName", "OriginalFileName", "OldName"),
    "file_new_name": ("NewFileName", "NewName", "FileName", "FilePath"),
    "net_pid": ("PID", "ProcessID"),
    "saddr": ("saddr", "SourceAddress", "LocalAddress"),
    "daddr": ("daddr", "DestinationAddress", "RemoteAddress"),
    "sport": ("sport", "SourcePort", "LocalPort"),
    "dport": ("dport", "DestinationPort", "RemotePort"),
    "size": ("size", "Size", "IOSize"),
    "command_line": ("CommandLine", "ProcessCommandLine"),
    "new_process_name": ("NewProcessName", "ImageName"),
    "parent_process_name": ("ParentProcessName", "ImageName"),
    "subject_user_name": ("SubjectUserName", "User"),
    "mandatory_label": ("MandatoryLabel",),
    "wmi_command_line": ("Commandline", "CommandLine"),
    "wmi_created_pid": ("CreatedProcessId", "CreatedProcessID"),
    "wmi_client_pid": ("ClientProcessId", "ClientProcessID"),
    "wmi_client_machine": ("ClientMachineFQDN", "ClientMachine"),
    "wmi_user": ("User",),
    "wmi_is_local": ("IsLocal",),
    "wmi_namespace": ("Namespace",),
    "wmi_event_filter": ("ESS", "EventFilter"),
    "wmi_consumer": ("CONSUMER", "Consumer"),
    "task_name": ("TaskName",),
    "user_context": ("UserContext",),
}

#: Fields without which an event of a shape is undecodable. One of several in a tuple is enough.
REQUIRED = {
    "process_start": (("image_name",),),
    "process_start_audit": (("new_process_name",),),
    "process_exit": (),
    "image_load": (("image_name",),),
    "registry_set": (("key_name",),),
    "dns_query": (("query_name",),),
    "script_block": (("script_text",),),
    "file_create": (("file_name",),),
    "file_rename": (("file_new_name", "file_old_name"),),
    "file_delete": (("file_name",),),
    "network_connect": (("saddr",), ("daddr",)),
    "network_disconnect": (("saddr",), ("daddr",)),
    "wmi_process": (("wmi_command_line",),),
    "wmi_subscription": (("wmi_namespace",), ("wmi_event_filter",)),
    "task_registered": (("task_name",),),
}
