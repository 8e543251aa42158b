"""Schemas of what devices send; never inferred."""

READING = """device_id string, timestamp string, location string, timezone string,
    readings struct<cts map<string, struct<real_power_w double, amps double, pf double>>, voltage_rms double>"""
HEARTBEAT = """device_id string, firmware_version string, wifi_rssi int, wifi_rssi_min int, wifi_rssi_avg int, wifi_ssid string,
    free_heap long, min_heap long, uptime_seconds long, ip_address string, boot_reason string, queue_depth int, total_sent long,
    total_failed long, total_dropped long, ct_calibrated boolean, crash_count long, errors array<struct<timestamp string, message string>>"""
DIAGNOSTICS = """uptime_s long, free_heap long, min_heap long, wifi_rssi int, sent long, failed long, dropped long, wifi_reconnects long,
    boot_reason string, firmware string"""
OFFER = "update_available boolean, version string, url string"
ERRORS = "array<struct<t string, m string>>"
COMMANDS = "commands array<struct<action string, value double>>"
