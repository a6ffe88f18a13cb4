"""The columns of packets and of alerts."""

PACKET_SCHEMA = (
    "packet_id long, ts double, src string, dst string, proto string, sport int, dport int, flags string, dns_qname string, dns_qtype int, arp_op int, "
    "arp_hwsrc string, arp_psrc string, arp_hwdst string, arp_pdst string, http_method string, http_uri string, size long"
)
ALERT_SCHEMA = "id string, ts double, alert_type string, severity string, src string, dst string, description string, evidence_json string, packet_id long"
