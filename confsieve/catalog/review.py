"""Word lists of the review queue: which control a directive is about."""

# Keywords per control, tested in this order.
CONTROL_KEYWORDS = [
    ('CIS-MGMT-01', ['telnet']),
    ('CIS-MGMT-02', ['ssh version', 'protocol-version', 'ssh server v2', 'sshd', 'stelnet', 'ssh server', 'ssh-port', 'sshport', 'protocol inbound ssh', 'ssh user', 'ssh port', 'disable-ssh', 'ssh.enable', 'admin-ssh', 'transport input', 'ssh maximum-auth', 'ssh login-attempts', 'dropbear']),
    ('CIS-MGMT-04', ['https', 'secure-server', 'ssl-port', 'web-management https', 'ssl-certref', 'uhttpd', 'redirect_https']),
    ('CIS-MGMT-03', ['http server', 'http.enable', 'disable-http', 'web http', 'http-port', 'protocol http', 'httpd', 'http_disable']),
    ('CIS-MGMT-05', ['snmp-server community', 'rocommunity', 'snmp.community', 'snmp-community', 'community']),
    ('CIS-MGMT-06', ['snmp v3', 'snmpv3', 'usm', 'agent-version', 'version v3', 'snmp-agent', 'snmp.status', 'snmp sysinfo', 'snmp-server user', 'snmp-server group', 'snmp-server host', 'snmp-server enable', 'snmp-server vrf', 'snmp.enable']),
    ('CIS-MGMT-07', ['idle-timeout', 'exec-timeout', 'session_timeout', 'session-idle', 'idletimeout', 'time-out', 'timeout']),
    ('CIS-MGMT-08', ['access-class', 'trusthost', 'allowed-client', 'permitted-ip', 'access-list', 'acl ', 'source-address', 'listen-address', 'src-address', 'allowed_masters', 'option interface']),
    ('CIS-AUTH-01', ['password-encryption', 'irreversible-cipher', 'password-hash', 'encrypted-password', 'sha512', 'sha256', '$6$', '$9$', '$5$', '$2y$', 'password enc', 'ciphertext', 'plaintext-password', 'secret', 'password=', 'password ', 'passwd', 'password_file', 'password-hash', 'authkey', 'network_key', 'app_key', 'pre-shared']),
    ('CIS-AUTH-02', ['min-length', 'minimum-length', 'min_length', 'password-policy', 'complexity', 'password_complexity']),
    ('CIS-AUTH-03', ['lockout', 'retry-options', 'block-for', 'failed-logins', 'tries', 'login_security', 'deny-on-failed', 'max-failed', 'sshguard', 'attempts', 'fail-times', 'limit-login']),
    ('CIS-AUTH-04', ['privilege', 'accprofile', 'login class', 'group administrators', 'authentication-mode', 'authorization', 'tacacs', 'radius', 'rba role', 'role ', "level 'admin'", 'service-type', 'aaa', 'local-user', 'username', 'user ']),
    ('CIS-LOG-01', ['logging host', 'syslog', 'loghost', 'logging server', 'log-remote', 'log_ip', 'logging synchronous', 'logging trap', 'log.remote', 'logging enable', 'logging 10.', 'log-settings', 'info-center', 'log target', 'logging.remote', 'logging.local', 'syslog.remote', 'log.remote.enable', 'remoteserver']),
    ('CIS-LOG-02', ['buffered', 'buffer-size', 'log memory', 'logging buffer']),
    ('CIS-LOG-03', ['log config', 'change-log', 'auditlog', 'interactive-commands', 'tamper', 'archive', 'log_type']),
    ('CIS-CRYPTO-01', ['cipher', 'aes256', 'hmac', 'strong-crypto', 'key-exchange', 'macs ', 'encryption algorithm', 'ssh_enc']),
    ('CIS-CRYPTO-02', ['tls', 'ssl-min', 'ssl-version', 'tls_version']),
    ('CIS-CRYPTO-03', ['crl', 'ocsp', 'certificate', 'pki', 'signature_verification', 'cert', 'secure_element']),
    ('CIS-ACL-01', ['any any', 'permit ip any', "default-action 'accept'", 'allow_anonymous', 'auth=none', 'srcaddr "all"', 'service "all"', "action 'accept'", 'encryption none', '0.0.0.0/0']),
    ('CIS-ACL-02', ['egress', 'outbound', 'masquerade', 'srcnat', 'forward', 'nat']),
]
