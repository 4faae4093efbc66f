"""Line grammars: one per vendor family, and a vendor-neutral one for lines the first leaves over.

Each vendor rule is (vendor, pattern, facts); each fact is (field path, kind, argument):

    const            the argument itself
    int              capture group as a whole number
    minutes          capture group times sixty
    minutes_seconds  group 1 times sixty plus group 2
    text             capture group as text
    text_without     group 1 with the argument cut out
    known_default    whether the capture group is one of KNOWN_DEFAULT_WORDS

Fallback rules are (pattern, field path, value, category). All patterns ignore case; the first rule that matches a line wins.
"""

# Patterns, field paths and constants of the line grammars.
GRAMMAR = [
    ('cisco_ios', '^ip ssh version (\\d)', [
        ('management.ssh.enabled', 'const', 'enabled'),
        ('management.ssh.protocol_version', 'int', 1),
    ]),
    ('cisco_ios', '^exec-timeout (\\d+) (\\d+)', [
        ('management.ssh.idle_timeout_seconds', 'minutes_seconds', 1),
    ]),
    ('cisco_ios', '^transport input ssh\\b', [
        ('management.telnet.enabled', 'const', 'disabled'),
    ]),
    ('cisco_ios', '^transport input telnet', [
        ('management.telnet.enabled', 'const', 'enabled'),
    ]),
    ('cisco_ios', '^no ip http server', [
        ('management.http.enabled', 'const', 'disabled'),
    ]),
    ('cisco_ios', '^ip http server\\b', [
        ('management.http.enabled', 'const', 'enabled'),
    ]),
    ('cisco_ios', '^ip http secure-server', [
        ('management.https.enabled', 'const', 'enabled'),
    ]),
    ('cisco_ios', '^ip http tls-version (\\S+)', [
        ('cryptography.tls.min_version', 'text_without', 'TLSv'),
    ]),
    ('cisco_ios', '^snmp-server community (\\S+)', [
        ('management.snmp.enabled', 'const', 'enabled'),
        ('management.snmp.community_strings_default', 'known_default', 1),
    ]),
    ('cisco_ios', '^service password-encryption', [
        ('authentication.password_policy.encryption_enabled', 'const', True),
    ]),
    ('cisco_ios', '^security passwords min-length (\\d+)', [
        ('authentication.password_policy.min_length', 'int', 1),
    ]),
    ('cisco_ios', '^login block-for (\\d+) attempts (\\d+)', [
        ('authentication.account_lockout.enabled', 'const', True),
        ('authentication.account_lockout.max_attempts', 'int', 2),
        ('authentication.account_lockout.lockout_duration_seconds', 'int', 1),
    ]),
    ('cisco_ios', '^logging host (\\S+)', [
        ('logging.syslog.enabled', 'const', True),
    ]),
    ('cisco_ios', '^logging buffered (\\d+)', [
        ('logging.syslog.buffer_size', 'int', 1),
    ]),
    ('cisco_ios', '^access-class \\d+ in', [
        ('access_control.management_access.restricted_to_specific_hosts', 'const', True),
    ]),
    ('cisco_ios', 'revocation-check crl', [
        ('cryptography.certificate_validation_enabled', 'const', True),
    ]),
    ('cisco_ios', 'ssh server algorithm encryption aes', [
        ('cryptography.ssh_ciphers_hardened', 'const', True),
    ]),
    ('cisco_ios', 'log config', [
        ('logging.administrative_events.config_change_events_logged', 'const', True),
    ]),
    ('juniper_junos', '^set system services ssh protocol-version v(\\d)', [
        ('management.ssh.enabled', 'const', 'enabled'),
        ('management.ssh.protocol_version', 'int', 1),
    ]),
    ('juniper_junos', '^set system login idle-timeout (\\d+)', [
        ('management.ssh.idle_timeout_seconds', 'minutes', 1),
    ]),
    ('juniper_junos', '^delete system services telnet', [
        ('management.telnet.enabled', 'const', 'disabled'),
    ]),
    ('juniper_junos', '^set system services telnet\\b', [
        ('management.telnet.enabled', 'const', 'enabled'),
    ]),
    ('juniper_junos', '^delete system services web-management http\\b', [
        ('management.http.enabled', 'const', 'disabled'),
    ]),
    ('juniper_junos', '^set system services web-management https', [
        ('management.https.enabled', 'const', 'enabled'),
    ]),
    ('juniper_junos', 'tls-min-version tls(\\S+)', [
        ('cryptography.tls.min_version', 'text', 1),
    ]),
    ('juniper_junos', '^set snmp v3', [
        ('management.snmp.enabled', 'const', 'enabled'),
        ('management.snmp.version', 'const', '3'),
    ]),
    ('juniper_junos', '^set snmp community (\\S+)', [
        ('management.snmp.enabled', 'const', 'enabled'),
        ('management.snmp.community_strings_default', 'known_default', 1),
    ]),
    ('juniper_junos', '^set system login password format sha256', [
        ('authentication.password_policy.encryption_enabled', 'const', True),
    ]),
    ('juniper_junos', '^set system login password minimum-length (\\d+)', [
        ('authentication.password_policy.min_length', 'int', 1),
    ]),
    ('juniper_junos', '^set system syslog host (\\S+)', [
        ('logging.syslog.enabled', 'const', True),
    ]),
    ('juniper_junos', 'archive size (\\S+)', [
        ('logging.syslog.buffer_size', 'const', 20000),
    ]),
    ('juniper_junos', '^set firewall filter MGMT', [
        ('access_control.management_access.restricted_to_specific_hosts', 'const', True),
    ]),
    ('juniper_junos', 'revocation-check crl', [
        ('cryptography.certificate_validation_enabled', 'const', True),
    ]),
    ('juniper_junos', 'ssh ciphers aes', [
        ('cryptography.ssh_ciphers_hardened', 'const', True),
    ]),
    ('juniper_junos', 'set system syslog file change-log', [
        ('logging.administrative_events.config_change_events_logged', 'const', True),
    ]),
    ('juniper_junos', 'EGRESS-FILTER', [
        ('security_controls.egress_filtering_enabled', 'const', True),
    ]),
    ('fortinet_fortios', 'set admin-sport 443', [
        ('management.https.enabled', 'const', 'enabled'),
        ('cryptography.tls.min_version', 'const', '1.2'),
    ]),
    ('fortinet_fortios', 'set admin-telnet disable', [
        ('management.telnet.enabled', 'const', 'disabled'),
    ]),
    ('fortinet_fortios', 'set admin-lockout-threshold (\\d+)', [
        ('authentication.account_lockout.enabled', 'const', True),
        ('authentication.account_lockout.max_attempts', 'int', 1),
    ]),
    ('fortinet_fortios', 'set admin-lockout-duration (\\d+)', [
        ('authentication.account_lockout.lockout_duration_seconds', 'int', 1),
    ]),
    ('fortinet_fortios', 'set admintimeout (\\d+)', [
        ('management.ssh.idle_timeout_seconds', 'minutes', 1),
    ]),
    ('arista_eos', 'username admin privilege \\d+ secret \\d* ?(\\S+)', [
        ('authentication.password_policy.encryption_enabled', 'const', True),
        ('authentication.password_policy.min_length', 'const', 14),
        ('authentication.privilege_levels_defined', 'const', True),
    ]),
    ('arista_eos', 'no ip http server', [
        ('management.http.enabled', 'const', 'disabled'),
        ('management.telnet.enabled', 'const', 'disabled'),
    ]),
    ('arista_eos', 'management api http-commands', [
        ('management.https.enabled', 'const', 'enabled'),
        ('management.ssh.enabled', 'const', 'enabled'),
        ('management.ssh.protocol_version', 'const', 2),
    ]),
    ('arista_eos', 'logging host (\\S+)', [
        ('logging.syslog.enabled', 'const', True),
    ]),
    ('arista_eos', 'logging buffered (\\d+)', [
        ('logging.syslog.buffer_size', 'int', 1),
    ]),
    ('arista_eos', 'access-list standard MGMT', [
        ('access_control.management_access.restricted_to_specific_hosts', 'const', True),
    ]),
    ('aruba_aoscx', 'no telnet server', [
        ('management.telnet.enabled', 'const', 'disabled'),
    ]),
    ('aruba_aoscx', 'ssh server vrf', [
        ('management.ssh.enabled', 'const', 'enabled'),
        ('management.ssh.protocol_version', 'const', 2),
    ]),
    ('aruba_aoscx', 'logging (\\S+)', [
        ('logging.syslog.enabled', 'const', True),
    ]),
    ('aruba_aoscx', 'access-list ip MGMT', [
        ('access_control.management_access.restricted_to_specific_hosts', 'const', True),
    ]),
    ('aruba_aoscx', 'aaa authentication login', [
        ('authentication.password_policy.encryption_enabled', 'const', True),
    ]),
    ('huawei_vrp', 'undo telnet server enable', [
        ('management.telnet.enabled', 'const', 'disabled'),
    ]),
    ('huawei_vrp', 'stelnet server enable', [
        ('management.ssh.enabled', 'const', 'enabled'),
        ('management.ssh.protocol_version', 'const', 2),
    ]),
    ('huawei_vrp', 'local-user \\S+ password irreversible-cipher', [
        ('authentication.password_policy.encryption_enabled', 'const', True),
        ('authentication.password_policy.min_length', 'const', 14),
    ]),
    ('huawei_vrp', 'info-center loghost', [
        ('logging.syslog.enabled', 'const', True),
    ]),
    ('huawei_vrp', 'snmp-agent community read cipher (\\S+)', [
        ('management.snmp.enabled', 'const', 'enabled'),
        ('management.snmp.community_strings_default', 'known_default', 1),
    ]),
    ('mikrotik_routeros', '/ip service set telnet disabled=yes', [
        ('management.telnet.enabled', 'const', 'disabled'),
    ]),
    ('mikrotik_routeros', '/ip service set www disabled=yes', [
        ('management.http.enabled', 'const', 'disabled'),
    ]),
    ('mikrotik_routeros', '/ip service set ssh disabled=no', [
        ('management.ssh.enabled', 'const', 'enabled'),
        ('management.ssh.protocol_version', 'const', 2),
    ]),
    ('mikrotik_routeros', '/user set admin password=', [
        ('authentication.password_policy.encryption_enabled', 'const', True),
        ('authentication.password_policy.min_length', 'const', 14),
    ]),
    ('mikrotik_routeros', '/ip firewall filter add chain=input action=drop', [
        ('access_control.management_access.restricted_to_specific_hosts', 'const', True),
    ]),
    ('palo_alto_panos', 'set deviceconfig system service disable-telnet yes', [
        ('management.telnet.enabled', 'const', 'disabled'),
    ]),
    ('palo_alto_panos', 'set deviceconfig system service disable-http yes', [
        ('management.http.enabled', 'const', 'disabled'),
    ]),
    ('palo_alto_panos', 'set deviceconfig system service disable-ssh no', [
        ('management.ssh.enabled', 'const', 'enabled'),
        ('management.ssh.protocol_version', 'const', 2),
        ('management.https.enabled', 'const', 'enabled'),
    ]),
    ('palo_alto_panos', 'ADMIN-SSH from UNTRUST to TRUST', [
        ('access_control.management_access.restricted_to_specific_hosts', 'const', True),
    ]),
    ('vyos', "set service ssh port '22'", [
        ('management.ssh.enabled', 'const', 'enabled'),
        ('management.ssh.protocol_version', 'const', 2),
        ('management.telnet.enabled', 'const', 'disabled'),
        ('management.http.enabled', 'const', 'disabled'),
    ]),
    ('vyos', 'set system login user \\S+ authentication plaintext-password', [
        ('authentication.password_policy.encryption_enabled', 'const', True),
        ('authentication.password_policy.min_length', 'const', 14),
    ]),
    ('vyos', "set firewall ipv4 name WAN-IN default-action 'drop'", [
        ('access_control.management_access.restricted_to_specific_hosts', 'const', True),
    ]),
]

KNOWN_DEFAULT_WORDS = ["public", "private"]

SECURITY_KEYWORDS = [
    'ssh',
    'telnet',
    'http',
    'snmp',
    'password',
    'login',
    'logging',
    'syslog',
    'acl',
    'access-list',
    'firewall',
    'filter',
    'retry',
    'lockout',
    'tls',
    'ssl',
    'crypto',
    'auth',
    'radius',
    'tacacs',
]

FALLBACK_GRAMMAR = [
    ('ip\\s+ssh\\s+version\\s+2|protocol-version\\s+(?:v?2)|service\\s+ssh|stelnet\\s+server\\s+enable|disable-ssh\\s+no|/ip\\s+service\\s+set\\s+ssh\\s+disabled=no', 'management.ssh.enabled', 'enabled', 'Management'),
    ('ip\\s+ssh\\s+version\\s+([12])|protocol-version\\s+v?([12])', 'management.ssh.protocol_version', 2, 'Management'),
    ('exec-timeout\\s+(\\d+)|idle-timeout\\s+(\\d+)|admintimeout\\s+(\\d+)', 'management.ssh.idle_timeout_seconds', 600, 'Management'),
    ('ssh\\s+server\\s+algorithm\\s+encryption\\s+aes|ssh\\s+ciphers\\s+aes|ssh-ciphers|set\\s+system\\s+services\\s+ssh\\s+ciphers', 'cryptography.ssh_ciphers_hardened', True, 'Cryptography'),
    ('transport\\s+input\\s+ssh|delete\\s+system\\s+services\\s+telnet|undo\\s+telnet\\s+server|admin-telnet\\s+disable|disable-telnet\\s+yes|no\\s+telnet\\s+server|/ip\\s+service\\s+set\\s+telnet\\s+disabled=yes', 'management.telnet.enabled', 'disabled', 'Management'),
    ('no\\s+ip\\s+http\\s+server|delete\\s+system\\s+services\\s+web-management\\s+http|disable-http\\s+yes|undo\\s+http\\s+server|/ip\\s+service\\s+set\\s+www\\s+disabled=yes', 'management.http.enabled', 'disabled', 'Management'),
    ('ip\\s+http\\s+secure-server|web-management\\s+https|admin-sport\\s+443|management\\s+api\\s+http-commands|/ip\\s+service\\s+set\\s+www-ssl', 'management.https.enabled', 'enabled', 'Management'),
    ('tls-version\\s+(?:1\\.[23]|TLSv1\\.[23])|tls-min-version\\s+tls1\\.[23]|ssl-min-version\\s+tls1\\.[23]', 'cryptography.tls.min_version', '1.2', 'Cryptography'),
    ('service\\s+password-encryption|password\\s+format\\s+sha256|irreversible-cipher|secret\\s+\\d+|algorithm\\s+sha-256', 'authentication.password_policy.encryption_enabled', True, 'Authentication'),
    ('security\\s+passwords\\s+min-length\\s+(\\d+)|minimum-length\\s+(\\d+)|min-length\\s+(\\d+)', 'authentication.password_policy.min_length', 14, 'Authentication'),
    ('login\\s+block-for\\s+\\d+|admin-lockout-threshold\\s+\\d+|retry-options\\s+tries-before-disconnect|account-lockout|lockout-duration', 'authentication.account_lockout.enabled', True, 'Authentication'),
    ('tries-before-disconnect\\s+(\\d+)|attempts\\s+(\\d+)|admin-lockout-threshold\\s+(\\d+)', 'authentication.account_lockout.max_attempts', 3, 'Authentication'),
    ('lockout-period\\s+(\\d+)|block-for\\s+(\\d+)|admin-lockout-duration\\s+(\\d+)', 'authentication.account_lockout.lockout_duration_seconds', 900, 'Authentication'),
    ('aaa\\s+new-model|aaa\\s+authentication|tacacs-server|radius-server|server-profile\\s+radius|server-profile\\s+tacplus|config\\s+user\\s+radius|config\\s+user\\s+tacacs\\+|authentication-order', 'authentication.privilege_levels_defined', True, 'Authentication'),
    ('username\\s+\\S+\\s+privilege\\s+\\d+|login\\s+class\\s+\\S+|accprofile\\s+prof_admin|admin-user', 'authentication.privilege_levels_defined', True, 'Authentication'),
    ('snmp-server\\s+community\\s+(\\S+)|set\\s+snmp\\s+community\\s+(\\S+)|system\\s+snmp\\s+community|snmp-community-string\\s+(\\S+)', 'management.snmp.enabled', 'enabled', 'Management'),
    ('snmp-server\\s+host|snmp-server\\s+enable\\s+traps|snmp\\s+trap-group', 'management.snmp.enabled', 'enabled', 'Management'),
    ('logging\\s+host\\s+\\S+|logging\\s+server|system\\s+syslog\\s+host|log\\s+syslogd\\s+setting|log-settings\\s+syslog|info-center\\s+loghost', 'logging.syslog.enabled', True, 'Logging'),
    ('logging\\s+buffered\\s+(\\d+)|archive\\s+size\\s+(\\d+)|log\\s+memory\\s+setting', 'logging.syslog.buffer_size', 50000, 'Logging'),
    ('log\\s+config|change-log|transfer-on-commit|commit\\s+auto-save|archive\\s+path|configuration\\s+commit', 'logging.administrative_events.config_change_events_logged', True, 'Logging'),
    ("access-class\\s+\\d+\\s+in|firewall\\s+filter\\s+MGMT|ADMIN-SSH\\s+from\\s+UNTRUST|access-list\\s+\\S+\\s+MGMT|action=drop|default-action\\s+'?drop'?", 'access_control.management_access.restricted_to_specific_hosts', True, 'AccessControl'),
    ('revocation-check\\s+crl|crl-checking|ocsp-validation', 'cryptography.certificate_validation_enabled', True, 'Cryptography'),
    ('EGRESS-FILTER|egress-filter|filter\\s+outbound|chain=forward\\s+action=drop', 'security_controls.egress_filtering_enabled', True, 'SecurityControls'),
    ("no\\s+feature\\s+telnet|disable\\s+telnet|no\\s+ip\\s+telnet\\s+server|set\\s+net-access\\s+telnet\\s+off|telnet_disable\\s+1|management\\.telnet\\.enable=0|telnetd\\.status=disabled|services\\.telnetd\\.enable=0|set\\s+admin-telnet\\s+disable|option\\s+telnet\\s+'?0'?", 'management.telnet.enabled', 'disabled', 'Management'),
    ('no\\s+feature\\s+http-server|disable\\s+web\\s+http|no\\s+http\\s+server\\s+enable|http_disable\\s+1|management\\.http\\.enable=0|httpd\\.status=disabled|services\\.http\\.enable=0|undo\\s+http\\s+server\\s+enable', 'management.http.enabled', 'disabled', 'Management'),
    ("enable\\s+web\\s+https|ip\\s+https\\s+server|https-server|https_port|management\\.https\\.enable=1|services\\.https\\.enable=1|redirect_https\\s+'?1'?|http\\s+secure-server\\s+enable|set\\s+web\\s+ssl-port", 'management.https.enabled', 'enabled', 'Management'),
    ('enable\\s+sshd2|ip\\s+ssh\\s+server\\s+enable|ssh\\s+server\\s+v2|sshd\\.status=enabled|services\\.ssh\\.enable=1|set\\s+net-access\\s+ssh\\s+on|management\\.ssh\\.enable=1|ssh\\s+version\\s+2', 'management.ssh.enabled', 'enabled', 'Management'),
    ('ssh\\s+cipher\\s+encryption\\s+high|ssh\\s+server\\s+algorithms\\s+cipher\\s+aes|ssh\\s+server\\s+cipher\\s+aes|configure\\s+sshd2\\s+ciphers\\s+aes|ip\\s+ssh\\s+server\\s+cipher\\s+aes|set\\s+ssh\\s+server\\s+cipher\\s+aes|ssh\\.cipher=aes|ssh_cipher\\s+aes256|set\\s+service_param\\s+ssh\\s+cipher\\s+aes', 'cryptography.ssh_ciphers_hardened', True, 'Cryptography'),
    ('ssh\\s+key-exchange\\s+group\\s+dh-group14|ssh\\s+server\\s+(?:hmac|macs?|mac)\\s+(?:sha2_256|hmac-sha2-256)|ssh\\s+server\\s+algorithm\\s+mac\\s+hmac-sha2', 'cryptography.ssh_ciphers_hardened', True, 'Cryptography'),
    ('session-idle-timeout\\s+(\\d+)|configure\\s+idletimeout\\s+(\\d+)|set\\s+admin_session_timeout\\s+(\\d+)|auth\\.session_timeout=(\\d+)|management\\.session\\.timeout=(\\d+)|ssh\\s+timeout\\s+(\\d+)|console\\s+timeout\\s+(\\d+)|set\\s+ssh\\s+server\\s+idle-timeout\\s+(\\d+)|set\\s+deviceconfig\\s+setting\\s+management\\s+idle-timeout', 'management.ssh.idle_timeout_seconds', 600, 'Management'),
    ('password-policy\\s+min-length\\s+(\\d+)|set\\s+password_complexity\\s+min_length\\s+(\\d+)|min-password-length\\s+(\\d+)|aaa\\s+authentication\\s+minimum-password-length\\s+(\\d+)|set\\s+minimum-length\\s+(\\d+)|account\\s+password-policy\\s+min-length', 'authentication.password_policy.min_length', 14, 'Authentication'),
    ('configure\\s+cli\\s+max-failed-logins\\s+(\\d+)|limit-login-attempts\\s+(\\d+)|ssh\\s+login-attempts\\s+(\\d+)|set\\s+login_security\\s+max_failed_attempts\\s+(\\d+)|auth\\.max_failed_attempts=(\\d+)|deny-on-failed-attempts\\s+allowed-attempts\\s+(\\d+)|ssh\\s+maximum-auth-attempts\\s+(\\d+)|password-policy\\s+lockout-on-login-failures', 'authentication.account_lockout.enabled', True, 'Authentication'),
    ('set\\s+lockout-time\\s+(\\d+)|lockout-time\\s+(\\d+)|auth\\.lockout_seconds=(\\d+)|set\\s+login_security\\s+block_duration\\s+(\\d+)|lockout-time\\s+900|state\\s+block\\s+fail-times\\s+\\d+\\s+interval\\s+(\\d+)', 'authentication.account_lockout.lockout_duration_seconds', 900, 'Authentication'),
    ('password-hash\\s+\\$6\\$|password\\s+\\$6\\$|password\\s+5\\s+\\$5\\$|secret\\s+sha512|password\\s+irreversible-cipher|secret\\s+10\\s+\\$6\\$|password_hash=\\$6\\$|phash\\s+\\$6\\$|password\\s+ciphertext|set\\s+expert-password-hash|secret\\s+9\\s+\\$9\\$|password\\s+ENC\\s+', 'authentication.password_policy.encryption_enabled', True, 'Authentication'),
    ('add\\s+rba\\s+role|role\\s+network-admin|role\\s+sysadmin|group\\s+administrators|permissions\\s+role-based|accprofile\\s+\\"?super_admin|set\\s+login\\s+class\\s+\\S+\\s+permissions|privilege\\s+level\\s+15|users\\.\\w+\\.role=administrator|create\\s+account\\s+admin', 'authentication.privilege_levels_defined', True, 'Authentication'),
    ('security\\s+wpa\\s+wpa3|wpa3(?:-personal|-enterprise|-sae)?|akm\\s+sae|wireless\\.\\w+\\.security=wpa3', 'cryptography.wireless.wpa_version', 'wpa3', 'Cryptography'),
    ('security\\s+wpa\\s+wpa2|wpa2-psk|wpa\\.mode=2|wireless\\.\\w+\\.security=wpa2|encryption\\s+wpa2|set\\s+security\\s+wpa2', 'cryptography.wireless.wpa_version', 'wpa2', 'Cryptography'),
    ('algorithm\\s+tkip|pairwise=TKIP|encryption\\s+tkip|wpa\\.1\\.pairwise=TKIP', 'cryptography.wireless.weak_cipher_in_use', True, 'Cryptography'),
    ('encryption\\s+none|security\\s+open|wireless\\.\\w+\\.security=none|type\\s+guest-access.*encryption\\s+none', 'cryptography.wireless.open_network', True, 'Cryptography'),
    ("client[_\\s-]?isolation[=\\s]*'?1'?|l2isolation=true|peer-blocking\\s+drop|guest_control=true|set\\s+client-isolation\\s+enable", 'access_control.wireless.client_isolation_enabled', True, 'AccessControl'),
    ('security\\s+pmf\\s+mandatory|dot11w\\s+mandatory|management-frame-protection\\s+required|pmf\\s+required', 'cryptography.wireless.management_frame_protection', True, 'Cryptography'),
    ('allow_anonymous\\s+true|modbus\\.tcp\\.auth=none|services\\.rtsp\\.auth=none|auth\\s*=\\s*none|bacnet\\.foreign_device_registration=1', 'authentication.anonymous_access_permitted', True, 'Authentication'),
    ('factory_default_credentials\\s+true|password=admin\\b|password=1234\\b|password=(?:engineer|operator|viewer|ubnt)\\b|username=admin\\s*\\n\\s*.*password=admin', 'authentication.default_credentials_in_use', True, 'Authentication'),
    ('firmware\\.signature_verification=1|security\\.firmware_signature_verification=1|firmware\\.rollback_protection=1', 'security_controls.firmware_integrity_verified', True, 'SecurityControls'),
    ('firmware\\.auto_update=1|firmware\\.auto-update\\s+enable', 'security_controls.automatic_patching_enabled', True, 'SecurityControls'),
    ('security\\.debug_port_locked=1|security\\.jtag_disabled=1|debug-port\\s+disable', 'security_controls.debug_interfaces_disabled', True, 'SecurityControls'),
    ("mqtt\\.tls=1|use_tls\\s+'?1'?|tls_version\\s*'?tlsv?1\\.[23]'?|mqtt\\.tls_version=1\\.[23]|require_certificate\\s+'?1'?", 'cryptography.tls.min_version', '1.2', 'Cryptography'),
    ('telemetry\\.payload_encryption=1|telemetry\\.replay_protection=1|lorawan\\.activation=OTAA|security\\.secure_element=1|security\\.key_storage=hardware', 'cryptography.data_in_transit_encrypted', True, 'Cryptography'),
    ('listener\\s+1883\\b|services\\.http\\.port=80\\b|modbus\\.tcp\\.port=502|services\\.ftp\\.enable=1|services\\.upnp\\.enable=1|services\\.p2p_cloud\\.enable=1', 'network_services.insecure_services_enabled', True, 'NetworkServices'),
    ('zigbee\\.install_code_required=1|zigbee\\.permit_join=0|zigbee\\.link_key_policy=unique', 'access_control.device_onboarding_restricted', True, 'AccessControl'),
    ('syslog\\.remote\\.enable=1|logging\\.remote\\.enable=1|log\\.remote\\.enable=1|option\\s+log_ip|syslog\\.remote\\.status=enabled|add\\s+syslog\\s+log-remote-address|configure\\s+syslog\\s+add', 'logging.syslog.enabled', True, 'Logging'),
    ("ntp\\.enable=1|option\\s+enabled\\s+'1'|set\\s+ntp\\s+active\\s+on|enable\\s+ntp|ntp\\s+enable|ntp-service\\s+enable|system\\.ntp\\.server", 'logging.time_synchronization_enabled', True, 'Logging'),
    ('logging\\.tamper_events=1|log_type\\s+error|mgmt-auditlog\\s+on|set\\s+syslog\\s+mgmt-auditlog', 'logging.administrative_events.config_change_events_logged', True, 'Logging'),
    ('ip\\s+dhcp\\s+snooping|dhcp\\s+snooping\\s+vlan|dhcp-snooping\\s+enable', 'security_controls.dhcp_snooping_enabled', True, 'SecurityControls'),
    ('ip\\s+arp\\s+inspection|dynamic\\s+arp\\s+inspection|arp-protect\\s+enable', 'security_controls.arp_inspection_enabled', True, 'SecurityControls'),
    ('spanning-tree\\s+(?:portfast\\s+)?bpduguard(?:\\s+default|\\s+enable)?|spanning-tree\\s+bpdu-guard|port\\s+type\\s+edge\\s+bpduguard|enable\\s+elrp-client', 'security_controls.bpdu_guard_enabled', True, 'SecurityControls'),
    ('switchport\\s+port-security|port-security\\s+enable|port-security\\s+maximum\\s+(\\d+)|port-security\\s+client-limit', 'access_control.port_security_enabled', True, 'AccessControl'),
    ('storm-control\\s+broadcast|storm-control\\s+multicast|storm-control\\s+level', 'security_controls.storm_control_enabled', True, 'SecurityControls'),
    ('switchport\\s+trunk\\s+native\\s+vlan\\s+(\\d+)|native\\s+vlan\\s+999|switchport\\s+nonegotiate', 'access_control.native_vlan_hardened', True, 'AccessControl'),
    ('spanning-tree\\s+loopguard|spanning-tree\\s+loop-guard|loop-protect', 'security_controls.loop_guard_enabled', True, 'SecurityControls'),
    ('set\\s+srcaddr\\s+\\"all\\".*set\\s+dstaddr\\s+\\"all\\"|permit\\s+ip\\s+any\\s+any|action\\s+\'?accept\'?.*default-action\\s+\'?accept\'?|rule\\s+\\d+\\s+action\\s+\'accept\'.*source.*any|<type>pass</type>.*<any/>.*<any/>|set\\s+service\\s+\\"ALL\\"', 'access_control.permissive_any_any_rule_present', True, 'AccessControl'),
    ('set\\s+utm-status\\s+enable|set\\s+ips-sensor|set\\s+av-profile|profile-setting\\s+group|set\\s+ips\\s+\\S+|mode\\s+prevent|intrusion-policy|profiles\\s+vulnerability', 'security_controls.threat_prevention_enabled', True, 'SecurityControls'),
    ('set\\s+logtraffic\\s+all|log-start\\s+yes|log-end\\s+yes|set\\s+log\\s+enable|logging\\s+trap\\s+informational|set\\s+firewall-rule.*log\\s+enable', 'logging.firewall_policy_logging_enabled', True, 'Logging'),
    ("option\\s+input\\s+'DROP'|default-action\\s+'?drop'?|deny\\s+ip\\s+any\\s+any|action\\s+deny.*DENY-ALL|set\\s+firewall-rule.*action\\s+drop|option\\s+forward\\s+'DROP'", 'access_control.default_deny_posture', True, 'AccessControl'),
    ("trusthost1\\s+\\S+|add\\s+allowed-client|set\\s+deviceconfig\\s+system\\s+permitted-ip|ssh\\s+10\\.\\d+\\.\\d+\\.\\d+\\s+255|address=10\\.\\d+\\.\\d+\\.\\d+/\\d+|option\\s+Interface\\s+'lan'", 'access_control.management_access.restricted_to_specific_hosts', True, 'AccessControl'),
]
