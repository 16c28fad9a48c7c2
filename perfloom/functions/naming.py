"""Process, application, provider and address names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Executable name -> display name.
DISPLAY_NAMES = {
    "chrome.exe": "Google Chrome",
    "msedge.exe": "Microsoft Edge",
    "msedgewebview2.exe": "Edge WebView2",
    "firefox.exe": "Mozilla Firefox",
    "brave.exe": "Brave",
    "opera.exe": "Opera",
    "code.exe": "VS Code",
    "devenv.exe": "Visual Studio",
    "pycharm64.exe": "PyCharm",
    "idea64.exe": "IntelliJ IDEA",
    "webstorm64.exe": "WebStorm",
    "rider64.exe": "Rider",
    "python.exe": "Python",
    "pythonw.exe": "Python (no console)",
    "node.exe": "Node.js",
    "java.exe": "Java",
    "javaw.exe": "Java (no console)",
    "docker.exe": "Docker",
    "dockerd.exe": "Docker Engine",
    "com.docker.backend.exe": "Docker Backend",
    "wsl.exe": "WSL",
    "wslhost.exe": "WSL Host",
    "teams.exe": "Microsoft Teams",
    "ms-teams.exe": "Microsoft Teams",
    "slack.exe": "Slack",
    "discord.exe": "Discord",
    "zoom.exe": "Zoom",
    "skype.exe": "Skype",
    "whatsapp.exe": "WhatsApp",
    "telegram.exe": "Telegram",
    "onedrive.exe": "OneDrive",
    "dropbox.exe": "Dropbox",
    "googledrive.exe": "Google Drive",
    "spotify.exe": "Spotify",
    "outlook.exe": "Outlook",
    "winword.exe": "Word",
    "excel.exe": "Excel",
    "powerpnt.exe": "PowerPoint",
    "explorer.exe": "Windows Explorer",
    "svchost.exe": "Service Host",
    "runtimebroker.exe": "Runtime Broker",
    "searchhost.exe": "Windows Search",
    "searchindexer.exe": "Windows Search Indexer",
    "smartscreen.exe": "SmartScreen",
    "msmpeng.exe": "Defender Antimalware",
    "mssense.exe": "Defender ATP Sense",
    "nissrv.exe": "Defender Network Inspection",
    "mpcmdrun.exe": "Defender Command Line",
    "securityhealthservice.exe": "Security Health Service",
    "wuauserv.exe": "Windows Update",
    "trustedinstaller.exe": "Windows Module Installer",
    "dwm.exe": "Desktop Window Manager",
    "csrss.exe": "Client-Server Runtime",
    "winlogon.exe": "Windows Logon",
    "services.exe": "Service Control Manager",
    "lsass.exe": "Local Security Authority",
    "taskmgr.exe": "Task Manager",
    "perfmon.exe": "Performance Monitor",
    "powershell.exe": "PowerShell",
    "pwsh.exe": "PowerShell 7",
    "cmd.exe": "Command Prompt",
    "conhost.exe": "Console Host",
    "claude.exe": "Claude",
    "cursor.exe": "Cursor",
    "notepad.exe": "Notepad",
    "notepad++.exe": "Notepad++",
    "obs64.exe": "OBS Studio",
    "steam.exe": "Steam",
    "epicgameslauncher.exe": "Epic Games",
}

# Event provider -> bucket (exact case).
PROVIDER_BUCKETS = {
    "Microsoft-Windows-Kernel-Power": "power",
    "Microsoft-Windows-Power-Troubleshooter": "power",
    "disk": "storage",
    "Disk": "storage",
    "Ntfs": "storage",
    "volmgr": "storage",
    "volsnap": "storage",
    "Microsoft-Windows-Ntfs": "storage",
    "Service Control Manager": "service",
    "DistributedCOM": "com",
    "Application Error": "app_crash",
    "Windows Error Reporting": "app_crash",
    ".NET Runtime": "app_crash",
    "Microsoft-Windows-Windows Defender": "defender",
    "Microsoft-Windows-WindowsUpdateClient": "update",
    "Microsoft-Windows-WMI-Activity": "wmi",
    "Microsoft-Windows-DNS-Client": "dns",
}

# Process names (lower case) of the security and background groups.
SECURITY_NAMES = (
    "msmpeng.exe", "mssense.exe", "mpcmdrun.exe", "smartscreen.exe", "nissrv.exe",
    "windowsdefender.exe",
)
BACKGROUND_NAMES = (
    "onedrive.exe", "teams.exe", "ms-teams.exe", "skype.exe", "chrome.exe", "msedge.exe",
    "firefox.exe", "searchindexer.exe", "searchhost.exe", "startmenuexperiencehost.exe",
    "runtimebroker.exe", "yourphone.exe", "phoneexperiencehost.exe", "dropbox.exe", "slack.exe",
    "adobe.exe", "creativecloud.exe",
)
# Processes that are always sampled.
CRITICAL_NAMES = (
    "msmpeng.exe", "mssense.exe", "mpcmdrun.exe", "smartscreen.exe", "system",
    "system idle process", "registry", "secure system", "memory compression", "wmiprvse.exe",
    "svchost.exe", "lsass.exe", "csrss.exe", "services.exe", "wininit.exe",
)
# Scanners whose presence among the top CPU users of a slowdown counts.
SCANNER_NAMES = ("msmpeng.exe", "mssense.exe", "mpcmdrun.exe")
# Markers of a VPN adapter.
VPN_MARKERS = (
    "vpn", "tap-", "tap0901", "wintun", "anyconnect", "globalprotect", "zscaler", "openvpn",
    "wireguard", "netextender", "pulse", "checkpoint",
)
# Addresses that are not remote hosts.
LOCAL_HOSTS = ("0.0.0.0", "::", "127.0.0.1", "::1")

IDLE_APP = "system idle process"


def _lookup(table: dict[str, str], key: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(mapping, key)


def app_key(name: Column | str) -> Column:
    """Lower-cased, trimmed process name; ``?`` when there is none."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("?")).otherwise(F.trim(F.lower(c), F.lit(" \t\n\r\x0b\x0c")))


def display_name(key: Column | str) -> Column:
    """Known display name, else the name without ``.exe`` with every letter run capitalised."""
    k = F.col(key) if isinstance(key, str) else key
    base = F.regexp_replace(k, r"\.exe$", "")
    runs = F.split(base, r"(?<=\P{L})(?=\p{L})")
    titled = F.array_join(
        F.transform(runs, lambda x: F.concat(F.upper(x.substr(1, 1)), x.substr(F.lit(2), F.length(x)))),
        "",
    )
    return F.coalesce(_lookup(DISPLAY_NAMES, k), titled)


def event_bucket(provider: Column | str) -> Column:
    p = F.col(provider) if isinstance(provider, str) else provider
    return F.coalesce(_lookup(PROVIDER_BUCKETS, p), F.lit("other"))


def strip_port(addr: Column | str) -> Column:
    """``[v6]:port`` -> v6; otherwise everything before the last colon."""
    a = F.coalesce(F.col(addr) if isinstance(addr, str) else addr, F.lit(""))
    bracketed = F.when(F.locate("]", a) > 0, F.regexp_extract(a, r"^\[([^\]]*)\]", 1)).otherwise(a)
    return F.when(a.startswith("["), bracketed).otherwise(F.regexp_replace(a, r":[^:]*$", ""))


def is_remote(host: Column) -> Column:
    return (host != "") & ~host.isin(*LOCAL_HOSTS)
