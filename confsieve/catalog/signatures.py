"""Vendor signatures and display names.

Only the families that have their own line grammar, and the ones those are easily mixed up with, are stated here. Signatures for further
families come from a labelled corpus (``operators.detection.mine_markers``) or from a JSON file (``load_signatures``).
"""

# The markers each family is scored on, and the names shown for family ids that plain title case would get wrong.
SIGNATURES = [
    {
        "vendor": 'cisco_ios',
        "strong": [
            'building configuration',
            'ip ssh version',
            'line vty',
            'service password-encryption',
        ],
        "weak": [
            'no ip http server',
            'logging buffered',
            'snmp-server community',
            'exec-timeout',
            'enable secret',
        ],
        "exclude": [
            'feature nxos',
            'install add file bootflash',
            'asa version',
            '! device: arista',
        ],
    },
    {
        "vendor": 'cisco_nxos',
        "strong": [
            'feature nxos',
            'feature bgp',
            'feature interface-vlan',
            'nxos.',
            'feature lacp',
        ],
        "weak": [
            'vdc ',
            'switchname',
            'feature ssh',
            'system jumbomtu',
        ],
    },
    {
        "vendor": 'cisco_iosxr',
        "strong": [
            'commit',
            'rp/0/rp0/cpu0',
            'interface mgmteth0/rp0/cpu0/0',
            'group root-lr',
        ],
        "weak": [
            'configure',
            'show configuration commit list',
            'tengige0/',
            'domain name',
        ],
        "exclude": [
            'building configuration',
            'switchport',
        ],
    },
    {
        "vendor": 'cisco_asa',
        "strong": [
            'asa version',
            'nameif',
            'security-level',
            'access-group',
            'same-security-traffic',
        ],
        "weak": [
            'object network',
            'object-group service',
            'class-map inspection_default',
            'anyconnect',
        ],
    },
    {
        "vendor": 'juniper_junos',
        "strong": [
            'set security policies',
            'set firewall filter',
            'set system login retry-options',
            'delete system services',
            'set routing-options',
            'family ethernet-switching',
            'root-authentication',
            'class super-user',
            'routing-instances',
            'protocol-version v2;',
            'instance-type virtual-router',
        ],
        "weak": [
            'set system services ssh',
            'set snmp',
            'set system syslog',
            'set interfaces ge-',
            'set vlans',
            'host-name',
            'encrypted-password',
            'system {',
            'interfaces {',
            'security {',
            'snmp {',
            'apply-groups',
        ],
        "exclude": [
            'set firewall ipv4 name',
            'set interfaces ethernet eth',
            'vyos',
            'disable-password-authentication',
        ],
    },
    {
        "vendor": 'vyos',
        "strong": [
            'vyos',
            'set firewall ipv4 name',
            'set interfaces ethernet eth',
            'disable-password-authentication',
        ],
        "weak": [
            'set service ssh',
            'set protocols static route',
            'set system host-name',
            'set system name-server',
        ],
        "exclude": [
            'edgeos',
            'edgerouter',
            'ubnt',
            'ubiquiti',
        ],
    },
    {
        "vendor": 'fortinet_fortios',
        "strong": [
            'config system global',
            'config firewall policy',
            'set admin-sport',
            'config system admin',
            'config wireless-controller',
            'wtp-profile',
            'intra-vap-privacy',
        ],
        "weak": [
            'set admin-lockout-threshold',
            'set srcintf',
            'set dstintf',
            'next',
            'edit ',
            'fortiap',
            'fortigate',
        ],
    },
    {
        "vendor": 'palo_alto_panos',
        "strong": [
            'set deviceconfig',
            'set rulebase security rules',
            'pan-os',
            'set deviceconfig system',
            'set mgt-config',
        ],
        "weak": [
            'service application-default',
            'set network virtual-router',
            'set profiles ',
            'set shared ',
            'set zone ',
        ],
        "contradicts": [
            'set system services',
            'delete system services',
            'set security policies',
            'set system host-name',
            'set system login',
            'from-zone',
        ],
        "structural": [
            ['set rulebase', 'action allow'],
            ['set deviceconfig', 'set network'],
            ['set zone', 'network layer3'],
        ],
    },
    {
        "vendor": 'arista_eos',
        "strong": [
            '! device: arista',
            'arista eos',
            'management api http-commands',
            'eos-',
            'dcs-7',
        ],
        "weak": [
            'management ssh',
            'management api',
            'cipher aes256-ctr',
            'spanning-tree mode mstp',
        ],
        "exclude": [
            'feature nxos',
            'switchname',
            'building configuration',
        ],
    },
    {
        "vendor": 'aruba_aoscx',
        "strong": [
            'aoscx',
            'aruba aoscx',
            'user admin group administrators',
            'ssh ciphers aes256-ctr',
            'port-security client-limit',
        ],
        "weak": [
            'ssh server vrf',
            'vlan access',
            'no telnet server',
            'aaa authentication login default local',
            'loop-protect',
        ],
    },
    {
        "vendor": 'huawei_vrp',
        "strong": [
            'stelnet server',
            'huawei vrp',
            'local-user',
            'undo telnet server enable',
            'vap-profile name',
            'ssid-profile name',
            'security-profile name',
            'sae-password cipher',
        ],
        "weak": [
            'sysname',
            'info-center loghost',
            'ip route-static',
            'acl number',
            'service-vlan vlan-id',
        ],
    },
    {
        "vendor": 'mikrotik_routeros',
        "strong": [
            '/system identity',
            '/ip service',
            '/ip firewall filter',
            'routeros',
            '/caps-man',
            '/interface wireless',
        ],
        "weak": [
            '/interface',
            '/ip address add',
            '/user set',
            '/system ntp client',
            'client-to-client-forwarding',
            'local-forwarding',
            'authentication-types=',
            'encryption=aes-ccm',
        ],
        "structural": [
            ['/caps-man', 'configuration add'],
            ['/caps-man', 'datapath'],
            ['/caps-man', 'security add'],
            ['/ip firewall', 'chain='],
            ['/system identity', 'set name='],
        ],
    },
    {
        "vendor": 'ubiquiti_edgeos',
        "strong": [
            'edgeos',
            'edgerouter',
            'set system login user ubnt',
        ],
        "weak": [
            'set service ssh port',
            'set interfaces ethernet eth',
            'set firewall name',
        ],
    },
]

DISPLAY_NAMES = {
    'cisco_ios': 'Cisco IOS / IOS-XE',
    'cisco_nxos': 'Cisco NX-OS',
    'cisco_iosxr': 'Cisco IOS-XR',
    'cisco_asa': 'Cisco ASA',
    'palo_alto_panos': 'Palo Alto PAN-OS',
    'fortinet_fortios': 'Fortinet FortiOS',
    'checkpoint_gaia': 'Check Point Gaia',
    'sophos_xg': 'Sophos XG',
    'pfsense': 'pfSense',
    'arista_eos': 'Arista EOS',
    'extreme_exos': 'Extreme EXOS',
    'dell_os10': 'Dell SmartFabric OS10',
    'sonic': 'SONiC',
    'aws_security_group': 'AWS Security Group',
    'azure_nsg': 'Azure NSG',
    'gcp_firewall': 'GCP Firewall',
    'huawei_vrp': 'Huawei VRP',
    'mikrotik_routeros': 'MikroTik RouterOS',
    'aruba_aoscx': 'Aruba AOS-CX',
    'vyos': 'VyOS',
    'ubiquiti_edgeos': 'Ubiquiti EdgeOS',
    'ubiquiti_unifi': 'Ubiquiti UniFi',
    'ruckus_smartzone': 'Ruckus SmartZone',
    'tplink_omada': 'TP-Link Omada',
    'f5_tmos': 'F5 BIG-IP TMOS',
    'openwrt': 'OpenWrt',
    'iot_embedded': 'IoT / Embedded',
    'extreme_wing': 'Extreme WiNG',
    'forcepoint': 'Forcepoint NGFW',
    'watchguard': 'WatchGuard Firebox',
    'sonicwall': 'SonicWall SonicOS',
    'barracuda': 'Barracuda CloudGen',
    'hillstone': 'Hillstone StoneOS',
    'sangfor': 'Sangfor NGAF',
    'kerio': 'Kerio Control',
    'opnsense': 'OPNsense',
    'iptables': 'Linux iptables',
    'nokia_sros': 'Nokia SR OS',
    'brocade_fastiron': 'Brocade FastIron',
    'allied_telesis': 'Allied Telesis AlliedWare Plus',
    'ruijie_rgos': 'Ruijie RGOS',
    'dlink': 'D-Link',
    'netgear': 'NETGEAR ProSAFE',
    'aruba_aoss': 'Aruba AOS-S',
    'ruckus_icx': 'Ruckus ICX',
    'mist': 'Juniper Mist',
    'cambium': 'Cambium cnPilot',
    'grandstream': 'Grandstream GWN',
    'engenius': 'EnGenius',
    'draytek': 'DrayTek Vigor',
    'siemens': 'Siemens SIMATIC',
    'schneider': 'Schneider Modicon',
    'rockwell': 'Rockwell ControlLogix',
    'mitsubishi': 'Mitsubishi MELSEC',
    'omron': 'Omron Sysmac',
    'beckhoff': 'Beckhoff TwinCAT',
    'wago': 'WAGO PFC',
    'phoenix_contact': 'Phoenix Contact PLCnext',
    'abb': 'ABB AC500',
    'emerson': 'Emerson DeltaV',
    'ge_vernova': 'GE Vernova PACSystems',
    'honeywell': 'Honeywell Niagara',
    'johnson_controls': 'Johnson Controls Metasys',
    'axis': 'Axis Communications',
    'hanwha': 'Hanwha Wisenet',
    'espressif': 'Espressif ESPHome',
    'particle': 'Particle Device OS',
    'teltonika': 'Teltonika RutOS',
    'advantech': 'Advantech WISE',
    'unknown': 'Unknown Vendor',
}
