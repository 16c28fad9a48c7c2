"""Columns of the timelines and JSON documents of a run folder."""

from __future__ import annotations

# kind of each column after coercion: f = nullable float, i = integer (missing is 0),
# s = text, cores = list of doubles, times = list of integers
TIMELINES: dict[str, dict[str, str]] = {
    "system": {
        "timestamp": "f", "rel_seconds": "f", "cpu_total_pct": "f", "cpu_per_core_pct": "cores",
        "cpu_freq_current_mhz": "f", "ctx_switches_per_sec": "f", "interrupts_per_sec": "f",
        "proc_queue_len": "s", "mem_total_bytes": "i", "mem_available_bytes": "i", "mem_used_bytes": "i",
        "mem_percent": "f", "swap_total_bytes": "i", "swap_used_bytes": "i", "swap_percent": "f",
        "commit_used_bytes": "s", "commit_total_bytes": "s",
        "disk_read_bytes_per_sec": "f", "disk_write_bytes_per_sec": "f", "disk_read_count_per_sec": "f",
        "disk_write_count_per_sec": "f", "disk_active_pct_est": "f",
        "net_sent_bytes_per_sec": "f", "net_recv_bytes_per_sec": "f", "net_packets_sent_per_sec": "f",
        "net_packets_recv_per_sec": "f", "net_errin_per_sec": "f", "net_errout_per_sec": "f",
        "net_dropin_per_sec": "f", "net_dropout_per_sec": "f",
    },
    "process": {
        "timestamp": "f", "rel_seconds": "f", "pid": "i", "name": "s", "cpu_pct": "f", "rss_bytes": "i",
        "vms_bytes": "i", "num_threads": "i", "num_handles": "i", "io_read_bps": "f", "io_write_bps": "f",
        "cpu_time_user": "f", "cpu_time_system": "f", "username": "s", "ppid": "i", "is_target": "i",
    },
    "network": {
        "timestamp": "f", "rel_seconds": "f", "adapter": "s", "bytes_sent_per_sec": "f",
        "bytes_recv_per_sec": "f", "packets_sent_per_sec": "f", "packets_recv_per_sec": "f",
        "errin_per_sec": "f", "errout_per_sec": "f", "dropin_per_sec": "f", "dropout_per_sec": "f",
        "is_up": "i", "speed_mbps": "i", "connections_established": "i-1",
    },
    "latency": {
        "timestamp": "f", "rel_seconds": "f", "target": "s", "count": "i", "avg_ms": "f", "min_ms": "f",
        "max_ms": "f", "jitter_ms": "f", "loss_pct": "f", "raw_times_ms": "times",
        "hostname_resolved": "s", "resolve_ms": "f",
    },
    "connections": {
        "timestamp": "f", "rel_seconds": "f", "pid": "i", "name": "s", "laddr": "s", "raddr": "s",
        "status": "s", "type": "s",
    },
    "gpu_engine": {"timestamp": "f", "rel_seconds": "f", "engine_type": "s", "luid": "s", "utilization_pct": "f"},
    "gpu_process": {"timestamp": "f", "rel_seconds": "f", "pid": "i", "dedicated_bytes": "i", "shared_bytes": "i"},
    "gpu_adapter": {
        "timestamp": "f", "rel_seconds": "f", "adapter": "s", "temperature_c": "f", "power_w": "f",
        "mem_used_mb": "f", "mem_total_mb": "f", "utilization_pct": "f",
    },
}
FILES = {
    "system": "timeline_system.csv", "process": "timeline_processes.csv", "network": "timeline_network.csv",
    "latency": "timeline_latency.csv", "connections": "timeline_connections.csv",
    "gpu_engine": "timeline_gpu_engine.csv", "gpu_process": "timeline_gpu_process.csv",
    "gpu_adapter": "timeline_gpu_adapter.csv",
}

MANIFEST = """
schema_version int, run_id string, hostname string, fqdn string, started_at string, ended_at string,
stop_reason string, mode string, duration_requested_seconds bigint, duration_actual_seconds double,
interval_seconds double, manual_stop boolean, tags array<string>,
target struct<name:string,pid:bigint,path:string>, latency_targets array<string>,
thresholds map<string,string>, phase3 struct<gpu:boolean,event_logs:boolean,etw_disk:boolean>
"""
PROCESS_EVENT = """
event string, pid bigint, ppid bigint, name string, cmdline string, username string,
create_time double, rel_seconds double, timestamp double
"""
SERVICE_EVENT = """
event string, name string, display_name string, status string, start_type string, from_status string,
to_status string, from_pid bigint, to_pid bigint, rel_seconds double, timestamp double
"""
EVENT_LOG = """
count bigint, start_wall double, end_wall double, events array<struct<time:string,id:bigint,level:string,
level_code:int,provider:string,log_name:string,machine:string,message:string,rel_seconds:double,timestamp:double>>
"""
PROCESS_SNAPSHOT = """
pid bigint, ppid bigint, name string, username string, create_time double, exe string, cmdline string,
num_threads bigint, num_handles bigint
"""
SERVICE_SNAPSHOT = """
name string, display_name string, status string, start_type string, pid bigint, binpath string, username string
"""
INVENTORY = """
security struct<antivirus_products:array<struct<displayName:string>>>,
network struct<adapters_psutil:array<struct<name:string>>,adapters_wmi:array<struct<Name:string>>>
"""
