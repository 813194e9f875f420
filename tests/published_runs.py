"""Published compute figures of twelve runs, and the published table and leaves made from them."""

# condition, seed, total_tokens, supervised_tokens, optimizer_steps, wall_clock_train_s, wall_clock_total_s, peak_allocated_gpu_memory_gib
RUNS = [
    ("C0", 42, 27912106, 9324220, 600, 6595.509965344, 9234.599359, 48.55882787704468),
    ("C0", 43, 27810517, 9289735, 600, 6572.7315387, 9212.293417, 48.54869747161865),
    ("C0", 44, 27878584, 9333739, 600, 6566.553466341, 9233.062723, 48.556538581848145),
    ("C1", 42, 42079575, 9324220, 600, 8196.646253296, 11213.090261, 58.88844919204712),
    ("C1", 43, 41919306, 9289735, 600, 8108.8773535630025, 11152.540941, 58.87525510787964),
    ("C1", 44, 42008210, 9333739, 600, 8147.969244084001, 11146.695659, 58.86917209625244),
    ("C2-control", 42, 41200283, 9150480, 600, 8041.038463570003, 11036.220112, 58.868361949920654),
    ("C2-control", 43, 41139089, 9091209, 600, 8055.960906589001, 11168.165782, 58.880640506744385),
    ("C2-control", 44, 41088913, 9093504, 600, 8069.869016201001, 11116.054924, 58.86417102813721),
    ("C2", 42, 37426063, 9258382, 600, 7962.4871298, 11026.112779, 58.871013164520264),
    ("C2", 43, 37586323, 9359318, 600, 7957.760083959001, 11009.823834, 58.85922193527222),
    ("C2", 44, 37367636, 9291430, 600, 7940.738180311004, 10962.199211, 58.86391258239746),
]

TABLE = {
    "total_tokens_m": ("27.9", "42.0", "37.5", "41.1"),
    "supervised_tokens_m": ("9.32", "9.32", "9.30", "9.11"),
    "optimizer_steps": ("600", "600", "600", "600"),
    "training_minutes": ("110", "136", "133", "134"),
    "end_to_end_minutes": ("154", "186", "183", "185"),
    "peak_allocated_gpu_memory_gib": ("48.6", "58.9", "58.9", "58.9"),
}
DIGITS = {"total_tokens_m": 1, "supervised_tokens_m": 2, "optimizer_steps": 0, "training_minutes": 0, "end_to_end_minutes": 0, "peak_allocated_gpu_memory_gib": 1}
LEAVES = {"training_hours": 25.615594889377228, "total_hours": 35.41968305611111, "training_time_over": 23.910549299544858, "total_time_over": 21.070739662896898, "tokens_over": 50.724009283741545, "memory_over": 21.260434200463664}
