"""Tables the device profile is read off: capabilities, models, class evidence, naming hints."""

# Patterns and names of the device profile.
CAPABILITIES = [
    ('BGP', '(?i)\\brouter\\s+bgp\\b|\\bprotocols\\s+bgp\\b|\\bbgp\\s+system-as\\b|\\bbgp\\s+\\d+\\b|\\bneighbor\\s+\\S+\\s+remote-as\\b|\\bpeer\\s+\\S+\\s+as-number\\b'),
    ('OSPF', '(?i)\\brouter\\s+ospf\\b|\\bprotocols\\s+ospf\\b|\\bospf\\s+\\d+\\b|\\barea\\s+[\\d.]+\\b'),
    ('ISIS', '(?i)\\brouter\\s+isis\\b|\\bprotocols\\s+isis\\b|\\bisis\\s+instance\\b'),
    ('EIGRP', '(?i)\\brouter\\s+eigrp\\b'),
    ('RIP', '(?i)\\brouter\\s+rip\\b'),
    ('STATIC_ROUTING', '(?i)\\bip\\s+route\\s+\\d|\\bip\\s+route-static\\b|\\bstatic\\s+route\\b|\\bset\\s+protocols\\s+static\\b|/ip\\s+route\\s+add|\\bip\\s+route\\s+0\\.0\\.0\\.0\\b'),
    ('MPLS', '(?i)\\bmpls\\s+(?:ip|ldp|label)\\b|\\bprotocols\\s+mpls\\b|\\bmpls\\s+ldp\\b'),
    ('VRF', '(?i)\\bip\\s+vrf\\b|\\bvrf\\s+(?:definition|forwarding|context)\\b|\\brouting-instances\\b|\\bvrf\\s+default\\b'),
    ('VXLAN_EVPN', '(?i)\\bvxlan\\b|\\bnve\\s+interface\\b|\\bevpn\\b|\\bl2vpn\\s+evpn\\b'),
    ('L2_SWITCHING', '(?i)\\bswitchport\\b|\\bfamily\\s+ethernet-switching\\b|\\bvlan\\s+(?:access|trunk|database|batch)\\b|\\bmac\\s*-?\\s*address-table\\b'),
    ('VLAN', '(?im)^\\s*vlan\\s+\\d+|\\binterface\\s+vlan\\s*\\d+|\\bset\\s+vlans\\b|\\bcreate\\s+vlan\\b|\\bconfigure\\s+vlan\\b'),
    ('STP', '(?i)\\bspanning-tree\\b|\\bmstp\\b|\\brstp\\b|\\bstp\\s+(?:enable|mode)\\b|\\benable\\s+stpd\\b'),
    ('PORT_SECURITY', '(?i)\\bport-security\\b|\\bport\\s+security\\b|\\bdot1x\\b|\\b802\\.1x\\b|\\bieee8021x\\b'),
    ('DHCP_SNOOPING', '(?i)\\bdhcp\\s+snooping\\b|\\bdhcp-snooping\\b|\\barp\\s+inspection\\b|\\barp-protect\\b'),
    ('LINK_AGGREGATION', '(?i)\\bport-channel\\b|\\bchannel-group\\b|\\blacp\\b|\\bae\\d+\\b|\\bbond\\d+\\b'),
    ('NAT', '(?i)\\bnat\\s+(?:inside|outside|source|destination|pool|rule)\\b|\\bip\\s+nat\\b|action=masquerade|\\bsrcnat\\b|\\bmasquerade\\b'),
    ('IPSEC_VPN', '(?i)\\bcrypto\\s+(?:isakmp|ipsec|map)\\b|\\bike(?:v2)?\\s+\\w+\\b|\\bipsec\\s+(?:vpn|policy|proposal)\\b|\\bsecurity\\s+ipsec\\b|\\bwireguard\\b'),
    ('SSL_VPN', '(?i)\\bssl-?vpn\\b|\\banyconnect\\b|\\bwebvpn\\b'),
    ('STATEFUL_POLICY', '(?i)\\bconfig\\s+firewall\\s+policy\\b|\\bset\\s+rulebase\\s+security\\s+rules\\b|\\bset\\s+security\\s+policies\\b|\\bfrom-zone\\b|\\bsecurity-zone\\b|\\bnameif\\b|\\bzone\\s+(?:trust|untrust|lan|wan)\\b|connection-state=established'),
    ('THREAT_PREVENTION', '(?i)\\butm-status\\b|\\bips-sensor\\b|\\bav-profile\\b|\\bintrusion-policy\\b|\\bthreat-prevention\\b|\\bwebfilter\\b|\\bweb-filter\\b|\\bantivirus\\b|\\bprofiles\\s+vulnerability\\b|\\bmode\\s+prevent\\b'),
    ('WIRELESS_RADIO', '(?i)\\bdot11(?:radio)?\\b|\\b802\\.11[abgnacax]+\\b|\\bradio\\s+(?:profile|\\d|enable|2\\.4|5)\\b|/interface\\s+wireless|\\bieee_mode\\b|\\bradio_table\\b|\\bcaps-man\\b'),
    ('WIRELESS_SSID', '(?i)\\bssid\\b|\\bwlan\\s+\\S+|\\bwlans\\b|\\bwlanconf\\b'),
    ('WPA_ENTERPRISE', '(?i)\\bwpa[23]?-enterprise\\b|\\bakm\\s+(?:dot1x|sae)\\b|\\bauth.*\\btype.*\\beap\\b|\\bdot1x\\s+authentication\\b|\\bsecurity\\s+dot1x\\b'),
    ('QOS', '(?i)\\bservice-policy\\b|\\bpolicy-map\\b|\\bclass-of-service\\b|\\bqos\\b|\\btraffic-class\\b'),
    ('MULTICAST', '(?i)\\bip\\s+pim\\b|\\bigmp\\b|\\bmsdp\\b|\\bprotocols\\s+pim\\b'),
    ('HA_CLUSTERING', '(?i)\\bhsrp\\b|\\bvrrp\\b|\\bglbp\\b|\\bstackwise\\b|\\bredundancy\\b|\\bcluster\\b|\\bvsx\\b|\\bmlag\\b|\\bvpc\\s+domain\\b|\\bha\\s+(?:group|peer)\\b'),
    ('MODBUS', '(?i)\\bmodbus\\b'),
    ('BACNET', '(?i)\\bbacnet\\b'),
    ('OPC_UA', '(?i)\\bopc[\\s-]?ua\\b'),
    ('DNP3', '(?i)\\bdnp3\\b'),
    ('PROFINET', '(?i)\\bprofinet\\b'),
    ('ETHERNET_IP', '(?i)\\bethernet[\\s/-]?ip\\b|\\bcipsecurity\\b'),
    ('MQTT', '(?i)\\bmqtt\\b|\\bmosquitto\\b'),
    ('COAP', '(?i)\\bcoap\\b|\\blwm2m\\b'),
    ('ZIGBEE', '(?i)\\bzigbee\\b|\\bz-wave\\b'),
    ('LORAWAN', '(?i)\\blorawan?\\b'),
    ('RTSP_ONVIF', '(?i)\\brtsp\\b|\\bonvif\\b'),
    ('CELLULAR_WAN', '(?i)\\bcgdcont\\b|\\bapn\\b|\\blte\\b|\\b(?:4g|5g)\\b|\\bsim\\s+\\d\\b|\\bqflock\\b'),
]

L3_CAPABILITIES = ['BGP', 'OSPF', 'ISIS', 'EIGRP', 'RIP', 'STATIC_ROUTING', 'MPLS', 'VRF']
L2_CAPABILITIES = ['L2_SWITCHING', 'VLAN', 'STP', 'PORT_SECURITY', 'DHCP_SNOOPING']
ROUTING_PROTOCOLS = ['BGP', 'OSPF', 'ISIS', 'EIGRP', 'RIP', 'MPLS']

# (pattern, device class, typical role, model label), most specific first
MODELS = [
    ('(?i)\\b(?:cx[\\s-]?)?(?:8400|9300|10000)\\b', 'network_switch', 'core', 'Aruba CX Core'),
    ('(?i)\\b(?:cx[\\s-]?)?(?:8320|8325|8360)\\b', 'network_switch', 'dc_leaf', 'Aruba CX 83xx'),
    ('(?i)\\b(?:cx[\\s-]?)?6400\\b', 'network_switch', 'distribution', 'Aruba CX 6400'),
    ('(?i)\\b(?:cx[\\s-]?)?(?:6100|6200|6300)\\b', 'network_switch', 'access', 'Aruba CX 62xx/63xx'),
    ('(?i)\\b(?:2930f|3810m|5400r)\\b', 'network_switch', 'access', 'Aruba AOS-S'),
    ('(?i)\\bap(?:1[0-9]{2}|2[0-9]{2}|5[0-9]{2}|6[0-9]{2})\\b|\\binstant\\s+ap\\b', 'wireless_ap', 'wireless_access', 'Aruba AP'),
    ('(?i)\\bcatalyst\\s*9[456]\\d\\d\\b|\\bc9[456]\\d\\d\\b', 'network_switch', 'core', 'Catalyst 94xx-96xx'),
    ('(?i)\\bcatalyst\\s*9[23]\\d\\d\\b|\\bc9[23]\\d\\d\\b|\\bws-c3(?:650|850)\\b|\\b3850\\b|\\b9300\\b|\\b9200\\b', 'network_switch', 'access', 'Catalyst 92xx/93xx'),
    ('(?i)\\bws-c2960\\b|\\b2960\\b|\\b3560\\b', 'network_switch', 'access', 'Catalyst 2960/3560'),
    ('(?i)\\bn9k-c95\\d\\d\\b|\\bnexus\\s*95\\d\\d\\b|\\bnexus\\s*7\\d\\d\\d\\b', 'network_switch', 'dc_spine', 'Nexus 95xx/7xxx'),
    ('(?i)\\bn9k\\b|\\bnexus\\s*9[23]\\d\\d\\b|\\bnexus\\s*3\\d\\d\\d\\b|\\bnexus\\s*9300\\b', 'network_switch', 'dc_leaf', 'Nexus 93xx'),
    ('(?i)\\basr\\s*9\\d\\d\\d\\b|\\bncs\\s*\\d\\d\\d\\d\\b', 'router', 'core', 'Cisco ASR 9000 / NCS'),
    ('(?i)\\basr\\s*10\\d\\d\\b|\\basr1001\\b|\\basr1002\\b', 'router', 'wan', 'Cisco ASR 1000'),
    ('(?i)\\bisr\\s*4\\d\\d\\d\\b|\\bisr4331\\b|\\bisr\\s*1\\d\\d\\d\\b|\\bc88\\d\\d\\b', 'router', 'branch', 'Cisco ISR'),
    ('(?i)\\basa\\s*5\\d\\d\\d\\b|\\basa\\s+version\\b|\\bfpr\\s*\\d\\d\\d\\d\\b|\\bfirepower\\b', 'firewall', 'perimeter', 'Cisco ASA / Firepower'),
    ('(?i)\\bair-ap\\b|\\bc91[0-9]{2}\\b|\\bap\\s*38\\d\\d\\b|\\baironet\\b', 'wireless_ap', 'wireless_access', 'Cisco Aironet / CW'),
    ('(?i)\\bwlc\\b|\\bc9800\\b|\\bair-ct\\d\\d\\d\\d\\b|\\b(?:3504|5520|8540)\\b', 'wireless_controller', 'wireless_access', 'Cisco WLC'),
    ('(?i)\\bmeraki\\b|\\bmx\\d\\d\\b|\\bms\\d\\d\\d\\b|\\bmr\\d\\d\\b', 'network_switch', 'access', 'Cisco Meraki'),
    ('(?i)\\bptx\\s*\\d+\\b', 'router', 'core', 'Juniper PTX'),
    ('(?i)\\bmx\\s*\\d+\\b|\\bmx\\s*series\\b|\\bmxseries\\b', 'router', 'edge', 'Juniper MX'),
    ('(?i)\\bacx\\s*\\d+\\b', 'router', 'access', 'Juniper ACX'),
    ('(?i)\\bqfx\\s*\\d+\\b', 'network_switch', 'dc_leaf', 'Juniper QFX'),
    ('(?i)\\bex\\s*\\d{4}\\b', 'network_switch', 'access', 'Juniper EX'),
    ('(?i)\\bsrx\\s*\\d+\\b', 'firewall', 'perimeter', 'Juniper SRX'),
    ('(?i)\\bap4[35]\\b|\\bmist\\b', 'wireless_ap', 'wireless_access', 'Juniper Mist AP'),
    ('(?i)\\bdcs-7[358]\\d\\d\\b|\\b7(?:280|300|500|800)\\b', 'network_switch', 'dc_spine', 'Arista 7280+'),
    ('(?i)\\bdcs-70\\d\\d\\b|\\b70(?:20|50|60)\\b', 'network_switch', 'dc_leaf', 'Arista 70xx'),
    ('(?i)\\bfortigate\\b|\\bfg-\\d+\\b|\\bfgt\\b', 'firewall', 'perimeter', 'FortiGate'),
    ('(?i)\\bfortiswitch\\b|\\bfs-\\d+\\b', 'network_switch', 'access', 'FortiSwitch'),
    ('(?i)\\bfortiap\\b|\\bfap-\\d+\\b', 'wireless_ap', 'wireless_access', 'FortiAP'),
    ('(?i)\\bpa-\\d+\\b|\\bpan-os\\b|\\bpanorama\\b', 'firewall', 'perimeter', 'Palo Alto PA'),
    ('(?i)\\bfirebox\\b', 'firewall', 'perimeter', 'WatchGuard Firebox'),
    ('(?i)\\bcloudgen\\b|\\bbarracuda\\b', 'firewall', 'perimeter', 'Barracuda CloudGen'),
    ('(?i)\\bsonicwall\\b|\\btz\\d+\\b|\\bnsa\\s*\\d+\\b', 'firewall', 'perimeter', 'SonicWall'),
    ('(?i)\\bngaf\\b|\\bsangfor\\b', 'firewall', 'perimeter', 'Sangfor NGAF'),
    ('(?i)\\bstoneos\\b|\\bhillstone\\b', 'firewall', 'perimeter', 'Hillstone'),
    ('(?i)\\bforcepoint\\b|\\bngfw\\b', 'firewall', 'perimeter', 'Forcepoint NGFW'),
    ('(?i)\\bgaia\\b|\\bcheck\\s*point\\b', 'firewall', 'perimeter', 'Check Point'),
    ('(?i)\\bpfsense\\b|\\bopnsense\\b|\\bkerio\\s+control\\b|\\bsophos\\s+(?:xg|sfos|firewall)\\b|\\bxgs\\d+\\b|\\bsg\\d+\\s+firewall\\b', 'firewall', 'perimeter', 'Open-source / Sophos FW'),
    ('(?i)\\bbig-?ip\\b|\\bviprion\\b|\\btmos\\b|\\bltm\\b', 'load_balancer', 'distribution', 'F5 BIG-IP'),
    ('(?i)\\b7750\\s*sr\\b|\\b7250\\s*ixr\\b|\\bsr\\s*os\\b', 'router', 'core', 'Nokia SR OS'),
    ('(?i)\\bccr\\d+\\b|\\brb\\d+\\b|\\bhex\\b', 'router', 'branch', 'MikroTik Router'),
    ('(?i)\\bcrs\\d+\\b', 'network_switch', 'access', 'MikroTik CRS'),
    ('(?i)\\bcap\\s*ac\\b|\\bhap\\b|\\bcapsman\\b', 'wireless_ap', 'wireless_access', 'MikroTik Wireless'),
    ('(?i)\\bar\\s*(?:20|30|40)\\d\\d\\b|\\bar\\d{3,4}\\b', 'router', 'branch', 'Huawei AR'),
    ('(?i)\\bs5\\d\\d\\d\\b|\\bs6\\d\\d\\d\\b|\\bs1\\d\\d\\d\\b|\\bce\\d\\d\\d\\d\\b', 'network_switch', 'access', 'Huawei S-series'),
    ('(?i)\\bx4[46]0\\b|\\bx6\\d\\d\\b|\\bsummit\\b', 'network_switch', 'access', 'Extreme Summit'),
    ('(?i)\\bdgs-\\d+\\b|\\bdxs-\\d+\\b', 'network_switch', 'access', 'D-Link DGS'),
    ('(?i)\\bm4[35]00\\b|\\bprosafe\\b|\\bgs\\d{3}\\b', 'network_switch', 'access', 'NETGEAR ProSAFE'),
    ('(?i)\\bedgerouter\\b|\\ber-\\d+\\b|\\bedgeos\\b', 'router', 'branch', 'Ubiquiti EdgeRouter'),
    ('(?i)\\buap\\b|\\bunifi\\s+ap\\b|\\bu6\\b|\\bnanohd\\b', 'wireless_ap', 'wireless_access', 'Ubiquiti UniFi AP'),
    ('(?i)\\bicx\\s*\\d+\\b|\\bnetiron\\b|\\bfastiron\\b', 'network_switch', 'access', 'Brocade/Ruckus ICX'),
    ('(?i)\\bs\\d\\d\\d\\d-on\\b|\\bos10\\b|\\bn\\d\\d\\d\\d\\b', 'network_switch', 'dc_leaf', 'Dell OS10'),
    ('(?i)\\beap\\d+\\b|\\bomada\\b|\\bgwn7\\d+\\b|\\bnwa\\d+\\b|\\bcnpilot\\b|\\bews\\d+\\b|\\bvigorap\\b|\\brg-ap\\b', 'wireless_ap', 'wireless_access', 'SMB Access Point'),
    ('(?i)\\bs7-1[25]00\\b|\\bsimatic\\b|\\bcpu\\s*15\\d\\d\\b', 'iot_controller', 'ot_cell', 'Siemens SIMATIC S7'),
    ('(?i)\\bm(?:580|340|241|251)\\b|\\bmodicon\\b', 'iot_controller', 'ot_cell', 'Schneider Modicon'),
    ('(?i)\\bcontrollogix\\b|\\bcompactlogix\\b|\\b55\\d\\d\\b|\\brslogix\\b', 'iot_controller', 'ot_cell', 'Rockwell Logix'),
    ('(?i)\\bmelsec\\b|\\biq-[rf]\\b', 'iot_controller', 'ot_cell', 'Mitsubishi MELSEC'),
    ('(?i)\\bsysmac\\b|\\bnj\\d+\\b|\\bnx\\d+\\b', 'iot_controller', 'ot_cell', 'Omron Sysmac'),
    ('(?i)\\bcx\\d{4}\\b|\\btwincat\\b|\\bbeckhoff\\b', 'iot_controller', 'ot_cell', 'Beckhoff TwinCAT'),
    ('(?i)\\bpfc200\\b|\\bwago\\b', 'iot_controller', 'ot_cell', 'WAGO PFC'),
    ('(?i)\\baxc\\s*f\\b|\\bplcnext\\b', 'iot_controller', 'ot_cell', 'Phoenix Contact PLCnext'),
    ('(?i)\\bac500\\b|\\brtu500\\b', 'iot_controller', 'ot_cell', 'ABB AC500'),
    ('(?i)\\bdeltav\\b|\\bovation\\b', 'iot_controller', 'ot_cell', 'Emerson DeltaV'),
    ('(?i)\\bmark\\s*vie\\b|\\bpacsystems\\b|\\brx3i\\b', 'iot_controller', 'ot_cell', 'GE PACSystems'),
    ('(?i)\\bniagara\\b|\\bjace\\b', 'iot_controller', 'building_automation', 'Honeywell Niagara'),
    ('(?i)\\bmetasys\\b|\\bnae\\b|\\bsne\\b', 'iot_controller', 'building_automation', 'Johnson Controls Metasys'),
    ('(?i)\\brut[xz]?\\d+\\b|\\bteltonika\\b|\\brutos\\b', 'iot_gateway', 'iot_edge', 'Teltonika RUT'),
    ('(?i)\\bbg9\\d\\b|\\bec2\\d\\b|\\bquectel\\b', 'iot_gateway', 'iot_edge', 'Quectel Modem'),
    ('(?i)\\bnport\\b|\\beds-\\d+\\b|\\bmoxa\\b', 'iot_gateway', 'iot_edge', 'Moxa'),
    ('(?i)\\bwise-\\d+\\b|\\badam-\\d+\\b|\\badvantech\\b', 'iot_gateway', 'iot_edge', 'Advantech WISE'),
    ('(?i)\\bopenwrt\\b', 'iot_gateway', 'iot_edge', 'OpenWrt'),
    ('(?i)\\bq3\\d\\b|\\bp32\\b|\\baxis\\b', 'iot_endpoint', 'iot_edge', 'Axis Camera'),
    ('(?i)\\bds-2cd\\b|\\bhikvision\\b', 'iot_endpoint', 'iot_edge', 'Hikvision Camera'),
    ('(?i)\\bipc-h[fd]w\\b|\\bdahua\\b', 'iot_endpoint', 'iot_edge', 'Dahua Camera'),
    ('(?i)\\bwisenet\\b|\\bhanwha\\b', 'iot_endpoint', 'iot_edge', 'Hanwha Wisenet'),
    ('(?i)\\btasmota\\b|\\bsonoff\\b', 'iot_endpoint', 'iot_edge', 'Tasmota Device'),
    ('(?i)\\besp32\\b|\\besphome\\b|\\bespressif\\b', 'iot_endpoint', 'iot_edge', 'Espressif ESP'),
    ('(?i)\\bboron\\b|\\bphoton\\b|\\bparticle\\b', 'iot_endpoint', 'iot_edge', 'Particle Device'),
    ('(?i)\\bshelly\\b', 'iot_endpoint', 'iot_edge', 'Shelly Device'),
]

# device class -> weighted patterns
CLASS_SIGNALS = {
    'network_switch': [
        ('(?i)\\bswitchport\\s+(?:mode|access|trunk)\\b', 4.0),
        ('(?i)\\bmac\\s*-?\\s*address-table\\b', 4.0),
        ('(?i)\\bspanning-tree\\b|\\benable\\s+stpd\\b', 3.0),
        ('(?i)\\bfamily\\s+ethernet-switching\\b', 4.0),
        ('(?i)\\bport-security\\b|\\bstorm-control\\b|\\bdhcp\\s+snooping\\b', 3.0),
        ('(?i)\\bvlan\\s+(?:access|trunk|batch)\\b|\\bconfigure\\s+vlan\\s+\\S+\\s+add\\s+ports\\b', 3.0),
        ('(?i)\\binterface\\s+(?:ethernet)?\\s?\\d+/\\d+/\\d+\\b', 1.5),
        ('(?i)\\bport-channel\\b|\\blacp\\b', 1.0),
    ],
    'router': [
        ('(?i)\\bencapsulation\\s+(?:ppp|hdlc|frame-relay|dot1q)\\b', 3.0),
        ('(?i)\\binterface\\s+(?:serial|atm|pos|dialer|cellular)\\b', 4.0),
        ('(?i)\\binterface\\s+tengige\\d+/\\d+/\\d+/\\d+\\b', 3.0),
        ('(?i)\\binterface\\s+ge-\\d+/\\d+/\\d+\\b', 2.0),
        ('(?i)\\bip\\s+vrf\\s+forwarding\\b|\\baddress-family\\s+vpnv4\\b', 3.0),
        ('(?i)\\bmpls\\s+ldp\\s+router-id\\b', 3.0),
        ('(?i)\\binterface\\s+(?:Loopback|Tunnel)\\d+', 1.0),
    ],
    'firewall': [
        ('(?i)\\bconfig\\s+firewall\\s+policy\\b', 4.0),
        ('(?i)\\bset\\s+rulebase\\s+security\\s+rules\\b', 4.0),
        ('(?i)\\bset\\s+security\\s+(?:policies|zones)\\b', 4.0),
        ('(?i)\\bnameif\\b|\\bsecurity-level\\b', 4.0),
        ('(?i)\\bfrom-zone\\b.*\\bto-zone\\b|\\bzone-pair\\b|\\bsecurity-zone\\b', 3.0),
        ('(?i)\\butm-status\\b|\\bips-sensor\\b|\\bav-profile\\b|\\bwebfilter\\b', 3.0),
        ('(?i)\\bsource_zone\\b|\\bdest_zone\\b|\\bfirewall-rule\\b', 3.0),
        ('(?i)\\bpolicy-type\\s+firebox\\b|\\bsystem\\s+management\\s+lockout\\b', 3.0),
        ('(?i)\\biptables\\b|\\bnftables\\b|\\bchain=(?:input|forward)\\b', 2.0),
        ("(?i)\\bdefault-action\\s+'?drop'?\\b|\\boption\\s+input\\s+'DROP'\\b", 2.0),
    ],
    'wireless_ap': [
        ('(?i)\\bdot11(?:radio)?\\b|\\b802\\.11[abgnacax]+\\b', 4.0),
        ('(?i)\\bradio\\s+(?:profile|\\d|2\\.4|5)\\b|\\bradio_table\\b|\\bieee_mode\\b', 3.0),
        ('(?i)\\bwpa[23]?(?:-personal|-enterprise|-psk)?\\b', 3.0),
        ('(?i)/interface\\s+wireless|\\bcaps-man\\b', 3.0),
        ('(?i)\\bssid\\b|\\bwlans?\\b', 2.0),
        ('(?i)\\bband-steering\\b|\\bchannel-width\\b|\\btx-power\\b|\\bclient_isolation\\b', 2.0),
    ],
    'wireless_controller': [
        ('(?i)\\bcapwap\\b|\\bap-group\\b|\\bap\\s+name\\b', 4.0),
        ('(?i)\\bwlan\\s+\\S+\\s+\\d+\\s+\\S+', 3.0),
        ('(?i)\\bap\\s+dot11\\s+(?:5ghz|24ghz)\\s+rrm\\b', 4.0),
        ('(?i)\\brogue\\s+ap\\b|\\bzonedirector\\b|\\bsmartzone\\b', 3.0),
    ],
    'load_balancer': [
        ('(?i)\\bltm\\s+(?:virtual|pool|node)\\b', 4.0),
        ('(?i)\\bpersistence\\s+(?:profile|cookie|source-addr)\\b', 3.0),
        ('(?i)\\bsnat\\s+(?:automap|pool)\\b', 3.0),
        ('(?i)\\bhealth\\s+monitor\\b|\\bmonitor\\s+http\\b', 2.0),
        ('(?i)\\bhaproxy\\b|\\bupstream\\s+\\S+\\s*\\{', 2.0),
    ],
    'iot_controller': [
        ('(?i)\\bprotectionlevel\\b|\\bsecurepgpccommunication\\b', 4.0),
        ('(?i)\\bcipsecurity\\b|\\brslogix5000project\\b|\\bfactorytalk\\b', 4.0),
        ('(?i)\\bslmpsecurity\\b|\\bsysmacsecurity\\b|\\bdeltavsecurity\\b|\\bmetasyssecurity\\b', 4.0),
        ('(?i)\\badssecurity\\b|\\btcconfig\\b|\\bmarkviepolicy\\b|\\babbconfiguration\\b', 4.0),
        ('(?i)\\bplcconfiguration\\b|\\bcybersecurityprofile\\b', 4.0),
        ('(?i)\\bmodbus\\b|\\bprofinet\\b|\\bdnp3\\b|\\bopc[\\s-]?ua\\b|\\bbacnet\\b', 2.0),
        ('(?i)\\bwritelock\\b|\\bwrite_protect\\b|\\boperationrights\\b', 2.0),
    ],
    'iot_gateway': [
        ('(?i)\\buci\\s+(?:set|commit)\\b|\\bpackage\\s+(?:network|firewall)\\b', 3.0),
        ('(?i)\\bcgdcont\\b|\\bapn\\b|\\bqflock\\b', 4.0),
        ('(?i)\\bmqtt\\b.*\\bbroker\\b|\\bmodbus_tcp\\b.*\\bgateway\\b', 3.0),
        ('(?i)\\bdropbear\\b|\\buhttpd\\b|\\bbusybox\\b', 2.0),
        ("(?i)\\boption\\s+proto\\s+'?(?:static|dhcp)'?", 2.0),
    ],
    'iot_endpoint': [
        ('(?i)\\bonvif\\b|\\brtsp\\b', 4.0),
        ('(?i)\\bmqtthost\\b|\\bwebpassword\\b|\\bsetoption\\d*\\b', 4.0),
        ('(?i)\\besphome\\b|\\bfallback_hotspot\\b', 4.0),
        ('(?i)\\bserialnumber\\b|\\bdevicename\\b|\\bdeviceid\\b', 2.0),
        ('(?i)\\blorawan?\\b|\\bzigbee\\b|\\bdev_eui\\b', 3.0),
        ('(?i)\\bfirmware[_\\s-]?version\\b|\\bsensor\\b|\\btelemetry\\b', 1.5),
    ],
}

# device class -> construct it cannot do without
CLASS_GATES = {
    'wireless_ap': '(?i)\\bdot11(?:radio)?\\b|\\b802\\.11[abgnacax]+\\b|\\bradio\\s*(?:profile|\\d|2\\.4|5|enable)\\b|\\bradio_table\\b|\\bieee_mode\\b|/interface\\s+wireless|\\bcaps-man\\b|\\bchannel[-_\\s]?width\\b|\\btx[-_\\s]?power\\b|\\bband[-_\\s]?steering\\b|\\bwpa[23]?(?:-personal|-enterprise|-psk)?\\b|\\bwireless\\.(?:radio|ssid)\\b|\\bwlanconf\\b|\\"wlans\\"|\\bap-group\\b|\\bcapwap\\b',
    'wireless_controller': '(?i)\\bcapwap\\b|\\bap-group\\b|\\bap\\s+name\\b|\\bap\\s+dot11\\b|\\bzonedirector\\b|\\bsmartzone\\b|\\brogue\\s+ap\\b|\\bwlc\\b',
    'load_balancer': '(?i)\\bltm\\s+(?:virtual|pool|node)\\b|\\bvirtual\\s+server\\b|\\bpool\\s+member|\\bsnat\\s+(?:automap|pool)\\b|\\bhaproxy\\b|\\bupstream\\s+\\S+\\s*\\{|\\bpersistence\\b|\\bbig-?ip\\b',
    'iot_controller': '(?i)\\bmodbus\\b|\\bprofinet\\b|\\bbacnet\\b|\\bdnp3\\b|\\bopc[\\s-]?ua\\b|\\bethernet[\\s/-]?ip\\b|\\bprotectionlevel\\b|\\bcipsecurity\\b|\\bslmpsecurity\\b|\\bsysmacsecurity\\b|\\bdeltavsecurity\\b|\\bmetasyssecurity\\b|\\badssecurity\\b|\\bmarkviepolicy\\b|\\babbconfiguration\\b|\\bplcconfiguration\\b|\\bniagara\\b|\\bplc\\b',
    'network_switch': '(?i)\\bswitchport\\b|\\bspanning-tree\\b|\\bmac\\s*-?\\s*address-table\\b|\\bvlan\\b|\\bfamily\\s+ethernet-switching\\b|\\bport-security\\b|\\bstp\\b|\\btrunk\\b|\\bport-channel\\b|\\blacp\\b|\\benable\\s+stpd\\b',
    'firewall': '(?i)\\bfirewall\\b|\\bpolicy\\b|\\brule\\b|\\bzone\\b|\\bnameif\\b|\\bacl\\b|\\baccess-list\\b|\\biptables\\b|\\butm\\b|\\bips\\b|\\bnat\\b',
}

# (device class, defining pattern, basis), in order of precedence
CASCADE = [
    ('iot_controller', '(?i)\\bprotectionlevel\\b|\\bcipsecurity\\b|\\bslmpsecurity\\b|\\bsysmacsecurity\\b|\\bdeltavsecurity\\b|\\bmetasyssecurity\\b|\\badssecurity\\b|\\bmarkviepolicy\\b|\\babbconfiguration\\b|\\bplcconfiguration\\b|\\brslogix5000project\\b|\\bmelsecconfig\\b|\\bniagara\\b|\\bfoxs?service\\b|\\btcconfig\\b|\\bmodbus\\.(?:tcp|write)\\b|\\bwrite_protect\\b|\\bsafety_plc\\b', 'industrial control platform schema'),
    ('iot_endpoint', '(?i)\\bonvif\\b|\\bservices\\.rtsp\\b|\\bmqtthost\\b|\\bwebpassword\\b|\\bsetoption\\d+\\b|\\besphome\\b|\\bfallback_hotspot\\b|\\blorawan?\\.\\w+\\b|\\bdev_eui\\b|\\bzigbee\\.\\w+\\b|\\bstream\\.main\\b|\\btpm_2_0_active\\b', 'camera / smart-device firmware keys'),
    ('iot_gateway', '(?i)\\bcgdcont\\b|\\bqflock\\b|\\bqsslcfg\\b|\\buci\\s+(?:set|commit)\\b|\\bpackage\\s+(?:network|firewall|system)\\b|\\bnport\\b|\\bwise-\\d+\\b|\\badam-\\d+\\b|\\bmodbus_tcp_firewall\\b', 'cellular / embedded gateway configuration'),
    ('wireless_controller', '(?i)\\bcapwap\\b|\\bap\\s+dot11\\s+(?:5ghz|24ghz)\\b|\\bap-group\\b|\\bap\\s+name\\b|\\brogue\\s+ap\\b|\\bzonedirector\\b|\\bsmartzone\\b|\\bwireless\\s+security\\s+dot11w\\b', 'wireless controller / AP management plane'),
    ('wireless_ap', '(?i)\\bdot11radio\\b|\\b802\\.11[abgnacax]{1,3}\\b|\\bradio\\s*(?:profile|\\d\\b|2\\.4|5g)|\\bradio\\.\\d\\b|\\bradio_table\\b|\\bieee_mode\\b|/interface\\s+wireless|\\bcaps-man\\b|\\bchannel[-_\\s]?width\\b|\\btx[-_\\s]?power\\b|\\bband[-_\\s]?steering\\b|\\bwireless\\.\\d?\\.?ssid\\b|\\bwlanconf\\b|\\bwireless\\.ssid\\d*\\b|\\bssid_broadcast\\b|\\bintra_bss\\b|\\bhide_ssid\\b|\\bset\\s+wireless\\b|\\bwireless\\s+ssid\\b|\\bwireless_networks\\b|\\bwlan\\s+ssid\\b|\\bssid\\s+\\d+\\s+\\"|\\bwifi[-_]?iface\\b|\\bclient[-_]?isolation\\b|\\bwireless\\s+auth\\b|\\bconfig\\s+wireless-controller\\b|\\bwtp-profile\\b|\\bintra-vap-privacy\\b|\\bwlan\\s+ssid-profile\\b|\\bopmode\\s+wpa\\b|\\bmfp-mandatory\\b|\\brf-band\\b|\\bencryption-type\\s+ccmp\\b|\\bauthentication-type\\s+wpa\\b|\\bprotected-mgmt-frame\\b|\\bvap-profile\\s+name\\b|\\bssid-profile\\s+name\\b', 'radio-layer configuration'),
    ('load_balancer', '(?i)\\bltm\\s+(?:virtual|pool|node)\\b|\\bsnat\\s+(?:automap|pool)\\b|\\bpersistence\\s+(?:profile|cookie|source-addr)\\b|\\bhaproxy\\b|\\bupstream\\s+\\S+\\s*\\{|\\bpool\\s+members?\\b|\\bbig-?ip\\b', 'load-balancing virtual server / pool constructs'),
    ('firewall', '(?i)\\bconfig\\s+firewall\\s+policy\\b|\\bset\\s+rulebase\\s+security\\s+rules\\b|\\bset\\s+security\\s+(?:policies|zones)\\b|\\bnameif\\b|\\bsecurity-level\\b|\\bfrom-zone\\b|\\bzone-pair\\b|\\bsecurity-zone\\b|\\bsource_zone\\b|\\bfirewall-rule\\b|\\bpolicy-type\\s+firebox\\b|\\butm-status\\b|\\bips-sensor\\b|\\bav-profile\\b|\\bwebfilter\\b|\\bweb-filter\\b|\\biptables\\b|\\bnftables\\b|\\bset\\s+firewall-rule\\b|\\bsystem\\s+management\\s+lockout\\b|\\baccess-group\\s+\\S+\\s+in\\s+interface\\b', 'stateful security policy / zone model'),
]

L2_FORWARDING = '(?i)\\bswitchport\\b|\\bmac\\s*-?\\s*address-table\\b|\\bspanning-tree\\b|\\benable\\s+stpd\\b|\\bfamily\\s+ethernet-switching\\b|\\bvlan\\s+(?:access|trunk|batch)\\b|\\bconfigure\\s+vlan\\s+\\S+\\s+add\\s+ports\\b|\\bport-security\\b|\\bstorm-control\\b|\\bdhcp\\s+snooping\\b|\\bswitchport\\s+mode\\b|\\bvlan\\s+database\\b'
ROUTED_ONLY = '(?i)\\bencapsulation\\s+(?:ppp|hdlc|frame-relay)\\b|\\binterface\\s+(?:serial|atm|pos|dialer|cellular)\\b|\\baddress-family\\s+vpnv4\\b|\\bmpls\\s+ldp\\s+router-id\\b|\\bip\\s+vrf\\s+forwarding\\b|\\binterface\\s+tengige\\d+/\\d+/\\d+/\\d+\\b|\\binterface\\s+ge-\\d+/\\d+/\\d+\\b|\\brouting-instances\\b|\\bip\\s+route-static\\b|/ip\\s+route\\s+add|\\bset\\s+protocols\\s+static\\b'

FILENAME_HINTS = [
    ('(?i)(?:^|[_\\-.])(?:wf|ap|wifi|wlan|wlc)(?:$|[_\\-.])|_wifi|wifi_', 'wireless_ap'),
    ('(?i)(?:^|[_\\-.])(?:sw|switch)(?:$|[_\\-.])|_sw[_\\-.]|switch', 'network_switch'),
    ('(?i)(?:^|[_\\-.])(?:fw|firewall|ngfw|utm)(?:$|[_\\-.])|firewall', 'firewall'),
    ('(?i)(?:^|[_\\-.])(?:rt|rtr|router)(?:$|[_\\-.])|router', 'router'),
    ('(?i)(?:^|[_\\-.])(?:lb|f5|bigip)(?:$|[_\\-.])', 'load_balancer'),
    ('(?i)(?:^|[_\\-.])(?:plc|scada|hmi|rtu)(?:$|[_\\-.])', 'iot_controller'),
    ('(?i)(?:^|[_\\-.])(?:cam|ipcam|camera|sensor)(?:$|[_\\-.])', 'iot_endpoint'),
    ('(?i)(?:^|[_\\-.])(?:gw|gateway|modem|cellular)(?:$|[_\\-.])', 'iot_gateway'),
]

VENDOR_CLASS = {
    'fortinet_fortios': 'firewall',
    'palo_alto_panos': 'firewall',
    'cisco_asa': 'firewall',
    'cisco_firepower': 'firewall',
    'checkpoint_gaia': 'firewall',
    'sophos_xg': 'firewall',
    'pfsense': 'firewall',
    'opnsense': 'firewall',
    'forcepoint': 'firewall',
    'watchguard': 'firewall',
    'sonicwall': 'firewall',
    'barracuda': 'firewall',
    'hillstone': 'firewall',
    'sangfor': 'firewall',
    'kerio': 'firewall',
    'iptables': 'firewall',
    'cisco_nxos': 'network_switch',
    'arista_eos': 'network_switch',
    'aruba_aoscx': 'network_switch',
    'aruba_aoss': 'network_switch',
    'extreme_exos': 'network_switch',
    'dell_os10': 'network_switch',
    'sonic': 'network_switch',
    'dlink': 'network_switch',
    'netgear': 'network_switch',
    'brocade_fastiron': 'network_switch',
    'ruckus_icx': 'network_switch',
    'h3c_comware': 'network_switch',
    'ruijie_rgos': 'network_switch',
    'allied_telesis': 'network_switch',
    'cisco_iosxr': 'router',
    'nokia_sros': 'router',
    'vyos': 'router',
    'ubiquiti_edgeos': 'router',
    'mikrotik_routeros': 'router',
    'huawei_vrp': 'router',
    'cisco_ios': 'router',
    'juniper_junos': 'router',
    'f5_tmos': 'load_balancer',
    'ruckus_smartzone': 'wireless_controller',
    'mist': 'wireless_ap',
    'cambium': 'wireless_ap',
    'grandstream': 'wireless_ap',
    'engenius': 'wireless_ap',
    'openwrt': 'iot_gateway',
    'teltonika': 'iot_gateway',
    'quectel': 'iot_gateway',
    'moxa': 'iot_gateway',
    'advantech': 'iot_gateway',
    'siemens': 'iot_controller',
    'schneider': 'iot_controller',
    'rockwell': 'iot_controller',
    'mitsubishi': 'iot_controller',
    'omron': 'iot_controller',
    'beckhoff': 'iot_controller',
    'wago': 'iot_controller',
    'phoenix_contact': 'iot_controller',
    'abb': 'iot_controller',
    'emerson': 'iot_controller',
    'ge_vernova': 'iot_controller',
    'honeywell': 'iot_controller',
    'johnson_controls': 'iot_controller',
    'axis': 'iot_endpoint',
    'hikvision': 'iot_endpoint',
    'dahua': 'iot_endpoint',
    'hanwha': 'iot_endpoint',
    'tasmota': 'iot_endpoint',
    'espressif': 'iot_endpoint',
    'particle': 'iot_endpoint',
    'shelly': 'iot_endpoint',
    'iot_embedded': 'iot_endpoint',
}

PLATFORMS = {
    'cisco_ios': 'Cisco IOS / IOS-XE',
    'cisco_nxos': 'Cisco NX-OS',
    'cisco_iosxr': 'Cisco IOS-XR',
    'cisco_asa': 'Cisco ASA OS',
    'cisco_firepower': 'Cisco FTD',
    'juniper_junos': 'Juniper Junos',
    'palo_alto_panos': 'PAN-OS',
    'fortinet_fortios': 'FortiOS',
    'arista_eos': 'Arista EOS',
    'aruba_aoscx': 'Aruba AOS-CX',
    'aruba_aoss': 'Aruba AOS-S',
    'extreme_exos': 'ExtremeXOS',
    'dell_os10': 'Dell SmartFabric OS10',
    'sonic': 'SONiC',
    'huawei_vrp': 'Huawei VRP',
    'mikrotik_routeros': 'MikroTik RouterOS',
    'vyos': 'VyOS',
    'nokia_sros': 'Nokia SR OS',
    'h3c_comware': 'H3C Comware',
    'openwrt': 'OpenWrt',
    'f5_tmos': 'F5 TMOS',
    'checkpoint_gaia': 'Check Point Gaia',
    'sophos_xg': 'Sophos XG (SFOS)',
    'pfsense': 'pfSense',
    'opnsense': 'OPNsense',
    'forcepoint': 'Forcepoint NGFW',
    'watchguard': 'WatchGuard Fireware',
    'sonicwall': 'SonicOS',
    'barracuda': 'Barracuda CloudGen',
    'hillstone': 'Hillstone StoneOS',
    'sangfor': 'Sangfor NGAF',
    'kerio': 'Kerio Control',
    'iptables': 'Linux netfilter',
    'brocade_fastiron': 'Brocade FastIron',
    'ruckus_icx': 'Ruckus FastIron',
    'allied_telesis': 'AlliedWare Plus',
    'ruijie_rgos': 'Ruijie RGOS',
    'dlink': 'D-Link DGS firmware',
    'netgear': 'NETGEAR ProSAFE',
    'zyxel': 'Zyxel ZLD',
    'ubiquiti_edgeos': 'Ubiquiti EdgeOS',
    'tplink_omada': 'TP-Link Omada',
    'ubiquiti_unifi': 'Ubiquiti UniFi',
    'ruckus_smartzone': 'Ruckus SmartZone',
    'mist': 'Juniper Mist Cloud',
    'cambium': 'Cambium cnMaestro',
    'grandstream': 'Grandstream GWN',
    'engenius': 'EnGenius Cloud',
    'draytek': 'DrayTek VigorAP',
    'siemens': 'Siemens TIA / SIMATIC',
    'schneider': 'Schneider EcoStruxure',
    'rockwell': 'Rockwell Studio 5000',
    'mitsubishi': 'Mitsubishi GX Works',
    'omron': 'Omron Sysmac Studio',
    'beckhoff': 'Beckhoff TwinCAT',
    'wago': 'WAGO e!COCKPIT',
    'phoenix_contact': 'Phoenix Contact PLCnext',
    'abb': 'ABB Automation Builder',
    'emerson': 'Emerson DeltaV',
    'ge_vernova': 'GE PACSystems',
    'honeywell': 'Tridium Niagara 4',
    'johnson_controls': 'Johnson Controls Metasys',
    'axis': 'AXIS OS',
    'hikvision': 'Hikvision firmware',
    'dahua': 'Dahua firmware',
    'hanwha': 'Hanwha Wisenet firmware',
    'tasmota': 'Tasmota',
    'espressif': 'ESPHome',
    'particle': 'Particle Device OS',
    'shelly': 'Shelly firmware',
    'teltonika': 'Teltonika RutOS',
    'quectel': 'Quectel AT firmware',
    'moxa': 'Moxa firmware',
    'advantech': 'Advantech WISE',
    'iot_embedded': 'Embedded Linux / RTOS',
    'cisco_meraki': 'Cisco Meraki Dashboard',
    'aruba_instant': 'Aruba InstantOS',
    'extreme_wing': 'Extreme WiNG',
}

HOSTNAME_PATTERNS = [
    '(?im)^\\s*hostname\\s+(\\S+)',
    '(?im)^\\s*switchname\\s+(\\S+)',
    '(?im)^\\s*sysname\\s+(\\S+)',
    "(?i)\\bset\\s+system\\s+host-name\\s+'?([^\\s';]+)",
    '(?i)\\bhost-name\\s+([^\\s;]+)',
    '(?i)\\bset\\s+hostname\\s+(\\S+)',
    '(?i)\\bset\\s+deviceconfig\\s+system\\s+hostname\\s+(\\S+)',
    '(?i)"?hostname"?\\s*[:=]\\s*"?([^",\\s]+)',
    '(?i)\\bconfigure\\s+snmp\\s+sysName\\s+"([^"]+)"',
    '(?i)\\bdevice[._]name\\s*[:=]\\s*"?([^",\\s]+)',
    '(?i)<Device\\s+name="([^"]+)"',
    '(?i)<Controller\\s+Name="([^"]+)"',
    '(?i)"NAME"\\s*:\\s*"([^"]+)"',
    '(?i)"name"\\s*:\\s*"([^"]+)"',
]

ROLE_NAME_HINTS = [
    ('(?i)\\b(?:spine)\\b', 'dc_spine'),
    ('(?i)\\b(?:leaf|tor)\\b', 'dc_leaf'),
    ('(?i)\\b(?:core|cor)\\b', 'core'),
    ('(?i)\\b(?:dist|distribution|idf|mdf)\\b', 'distribution'),
    ('(?i)\\b(?:access|acc|edge-sw)\\b', 'access'),
    ('(?i)\\b(?:wan|mpls)\\b', 'wan'),
    ('(?i)\\b(?:branch|br|site|retail|store)\\b', 'branch'),
    ('(?i)\\b(?:perim|perimeter|dmz|internet|inet)\\b', 'perimeter'),
    ('(?i)\\b(?:edge|pe|ce)\\b', 'edge'),
    ('(?i)\\b(?:guest|wifi|wlan|ap)\\b', 'wireless_access'),
]

ASSET_GROUPS = {
    'router': 'network',
    'network_switch': 'network',
    'load_balancer': 'network',
    'wireless_controller': 'network',
    'firewall': 'security',
    'security_appliance': 'security',
    'wireless_ap': 'iot',
    'iot_gateway': 'iot',
    'iot_controller': 'iot',
    'iot_endpoint': 'iot',
    'unknown': 'unknown',
}

CLASS_DISPLAY = {
    'router': 'Router',
    'network_switch': 'Switch',
    'firewall': 'Firewall',
    'wireless_ap': 'Wireless AP',
    'wireless_controller': 'Wireless Controller',
    'load_balancer': 'Load Balancer',
    'security_appliance': 'Security Appliance',
    'iot_gateway': 'IoT Gateway',
    'iot_controller': 'Industrial Controller',
    'iot_endpoint': 'IoT Endpoint',
    'unknown': 'Unidentified',
}

ROLE_DISPLAY = {
    'core': 'Core',
    'distribution': 'Distribution',
    'access': 'Access',
    'edge': 'Edge',
    'wan': 'WAN',
    'internet_gateway': 'Internet Gateway',
    'dc_leaf': 'Data Centre Leaf',
    'dc_spine': 'Data Centre Spine',
    'branch': 'Branch',
    'wireless_access': 'Wireless Access',
    'perimeter': 'Perimeter',
    'segmentation': 'Internal Segmentation',
    'ot_cell': 'OT Cell / Plant Floor',
    'building_automation': 'Building Automation',
    'iot_edge': 'IoT Edge',
    'unknown': 'Undetermined',
}

COARSE_TYPES = {"network_switch": "switch", "iot_controller": "iot_device", "iot_endpoint": "iot_device", "iot_gateway": "iot_device", "wireless_controller": "wireless_ap"}
