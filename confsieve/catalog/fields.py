"""The fields of a security baseline and the type each one holds."""

# Field paths and their types. "state" is enabled / disabled text.
FIELD_TYPES = {
    "management.ssh.enabled": "state",
    "management.ssh.protocol_version": "int",
    "management.ssh.idle_timeout_seconds": "int",
    "management.telnet.enabled": "state",
    "management.http.enabled": "state",
    "management.https.enabled": "state",
    "management.snmp.enabled": "state",
    "management.snmp.version": "str",
    "management.snmp.community_strings_default": "bool",
    "authentication.password_policy.encryption_enabled": "bool",
    "authentication.password_policy.min_length": "int",
    "authentication.account_lockout.enabled": "bool",
    "authentication.account_lockout.max_attempts": "int",
    "authentication.account_lockout.lockout_duration_seconds": "int",
    "authentication.privilege_levels_defined": "bool",
    "cryptography.tls.min_version": "str",
    "cryptography.ssh_ciphers_hardened": "bool",
    "cryptography.certificate_validation_enabled": "bool",
    "access_control.management_access.restricted_to_specific_hosts": "bool",
    "logging.syslog.enabled": "bool",
    "logging.syslog.buffer_size": "int",
    "logging.administrative_events.config_change_events_logged": "bool",
    "security_controls.egress_filtering_enabled": "bool",
    "access_control.acl_rules[].is_any_any_permit": "bool",
}

ACL_PATH = "access_control.acl_rules[].is_any_any_permit"
STATES = ["enabled", "disabled"]
