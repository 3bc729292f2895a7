"""Fixed values. They decide the results and must not be changed."""

# -- feature vector, canonical order ----------------------------------------
FEATURES = [
    "argsNum",
    "returnValue",
    "eventId_freq",
    "mountNamespace_freq",
    "args_total_length",
    "has_sensitive_path",
    "has_canary_path",
    "has_path_traversal",
    "has_shell_metachar",
    "has_url_or_ip",
    "processName_freq",
    "is_shell",
    "is_interpreter",
    "is_basic_recon",
    "is_recon_tool",
    "is_network_tool",
    "is_privileged_helper",
    "syscall_rate_5s",
    "unique_syscalls_5s",
    "failed_call_ratio_5s",
    "inter_arrival_ms",
    "is_thread_event",
]

# Legacy vector: raw identifiers read as numbers.
LEGACY_FEATURES = [
    "processId",
    "parentProcessId",
    "userId",
    "mountNamespace",
    "eventId",
    "argsNum",
    "returnValue",
]

# -- patterns searched in the joined argument values --------------------------
ARGS_PATTERNS = {
    "has_sensitive_path": r"/etc/(shadow|passwd|sudoers|gshadow)|/root/|/\.ssh/|/\.aws/|\.bash_history|/\.docker/",
    "has_canary_path": r"\.aws/credentials|\.ssh/id_rsa|\.env\b|notes\.txt|\.jenkins_token",
    "has_path_traversal": r"\.\./",
    "has_shell_metachar": r"[|;`]|\$\(|&&",
    "has_url_or_ip": r"https?://|\b\d{1,3}(\.\d{1,3}){3}\b",
}

# -- process-name lexicons -----------------------------------------------------
NAME_LEXICONS = {
    "is_shell": ["bash", "sh", "dash", "zsh", "ksh", "ash", "csh", "tcsh", "fish"],
    "is_interpreter": ["python", "python3", "perl", "ruby", "node", "lua", "php"],
    "is_basic_recon": ["id", "whoami", "w", "uname", "hostname", "ss", "netstat", "lsof", "ps", "who"],
    "is_recon_tool": [
        "nmap", "masscan", "nikto", "gobuster", "dirb", "whatweb", "sqlmap", "hydra", "hashcat", "john",
    ],
    "is_network_tool": [
        "nc", "ncat", "socat", "curl", "wget", "ssh", "scp", "rsync", "ftp", "telnet", "dig", "host", "nslookup",
    ],
    "is_privileged_helper": ["sudo", "su", "doas", "pkexec", "polkit", "sudoedit"],
}

# -- process names whose severity is capped ------------------------------------
CAP_TO_ZERO = [
    "systemd", "systemd-logind", "systemd-journal", "systemd-journald", "systemd-network", "systemd-resolve",
    "systemd-resolved", "systemd-udevd", "systemd-tmpfiles", "systemd-timedated", "systemd-localed",
    "systemd-userdbd",
    "init", "kthreadd", "ksoftirqd", "migration", "rcu_sched", "kworker",
    "dbus-daemon", "dbus-broker", "dbus-broker-lau", "wireplumber", "pipewire", "pipewire-pulse", "pulseaudio",
    "gnome-shell", "gnome-session", "gdm", "gdm3", "Xorg", "Xwayland", "evolution-calend", "evolution-source-",
    "snapd", "snap", "snap-confine", "apt", "dpkg", "unattended-upgr",
    "agetty", "getty", "login",
    "NetworkManager", "wpa_supplicant", "avahi-daemon", "dhclient",
    "ssh-agent", "gpg-agent", "polkitd",
    "containerd", "containerd-shim", "dockerd",
    "tracee",
    "clear_console", "dircolors", "lesspipe", "lesspipe.sh",
    "10-uname", "20-updates", "50-motd-news", "00-header", "10-help-text", "50-landscape-sysinfo", "80-livepatch",
    "85-fwupd", "90-updates-available", "91-release-upgrade", "95-hwe-eol",
    "udisksd", "thermald", "rsyslogd", "cron", "crond", "anacron", "logrotate",
]
CAP_TO_ONE = ["sshd", "sudo", "su", "doas", "pkexec", "sudoedit", "run-parts", "env", "pam_unix"]

# -- users that are never tracked: (first, last) -------------------------------
UNTRACKED_USER_RANGES = [(0, 0), (1, 32), (65, 65), (100, 125), (993, 998)]

# -- event ids of kernel hooks, all >= 1000 -------------------------------------
HOOK_EVENT_IDS = {
    "security_file_open": 1000,
    "security_inode_unlink": 1001,
    "security_socket_create": 1002,
    "security_socket_listen": 1003,
    "security_socket_connect": 1004,
    "security_socket_accept": 1005,
    "security_socket_bind": 1006,
    "security_socket_setsockopt": 1007,
    "security_sb_mount": 1008,
    "security_bpf": 1009,
    "security_bpf_map": 1010,
    "security_kernel_read_file": 1011,
    "security_post_read_file": 1012,
    "security_inode_mknod": 1013,
    "security_inode_symlink": 1014,
    "security_mmap_file": 1015,
    "security_file_mprotect": 1016,
    "cap_capable": 1100,
    "cgroup_attach_task": 1101,
    "cgroup_mkdir": 1102,
    "cgroup_rmdir": 1103,
    "security_bprm_check": 1104,
    "sched_process_exec": 1200,
    "sched_process_exit": 1201,
    "sched_process_fork": 1202,
    "do_exit": 1203,
    "commit_creds": 1204,
    "switch_task_ns": 1205,
}

# Names the key=value audit dialect knows; all others become syscall_<n>.
AUDIT_KV_NAMES = {2: "open", 59: "execve", 257: "openat"}

# -- audit line patterns ---------------------------------------------------------
AUDIT_SYSCALL_PATTERN = (
    r"(?i)type=SYSCALL.*?syscall=(\d+).*?success=(\w+).*?exit=(-?\d+).*?"
    r"a0=([0-9a-f]+).*?ppid=(\d+).*?pid=(\d+).*?uid=(\d+).*?comm=\"([^\"]*)\""
)
AUDIT_TIME_PATTERN = r"msg=audit\((\d+\.\d+):\d+\)"
AUDIT_KV_TIME_PATTERN = r"audit\((\d+\.\d+):"
AUDIT_KV_PATTERN = r"(\w+)=(\".*?\"|\S+)"

# -- defaults ----------------------------------------------------------------------
LOW_PERCENTILE = 2.0
HIGH_PERCENTILE = 0.2
FALLBACK_LOW = -0.02
FALLBACK_HIGH = -0.10
DRIFT_SAMPLE = 100_000
DRIFT_MIN_SAMPLE = 100
ALERT_COUNT = 5
ALERT_WINDOW_S = 60
ALERT_MIN_RATE = 0.30
ALERT_MIN_SEVERITY = 2
FEATURE_WINDOW_S = 5
SERVING_GAP_S = 60
SCORES_PER_ENTITY = 500_000
TRAIN_SAMPLE = 10_000_000
N_TREES = 2000
CONTAMINATION = 0.03
SEED = 42
LEGACY_N_TREES = 300
LEGACY_CONTAMINATION = 0.01
SWEEP_FROM, SWEEP_TO, SWEEP_STEPS = 0.1, 50.0, 200
RETAIN_SCORES = 50_000
RETAIN_EVENTS = 10_000
RETAIN_COMMANDS = 1_000
RETAIN_REGISTRATIONS = 500
EXCLUDED_SYSCALLS = ["clock_gettime", "gettimeofday", "nanosleep", "poll", "epoll_wait"]
