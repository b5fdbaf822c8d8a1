"""The tables of a trace. Times are nanoseconds; an open end is null; ``seq`` gives a total order of arrival."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "capture": "capture_id string, name string, program string, capture_time long, exec_time long, host_info string, pid long, resolution long, sampling_period long, first_time long, last_time long, on_demand boolean, frame_offset long, cpu_arch string, cpu_id string",
    "trace_events": "capture_id string, seq long, time long, thread long, kind string, name string, text string, file string, line int, payload string",
    "source_locations": "capture_id string, srcloc int, name string, function string, file string, line int, color int",
    "zones": "capture_id string, zone_id long, thread long, srcloc int, start long, end long, end_seq long, depth int, parent_id long, name_override string, text string, color int, callstack int, reentrant boolean",
    "gpu_contexts": "capture_id string, ctx int, name string, type string, thread long, period double, time_diff long",
    "gpu_zones": "capture_id string, gpu_zone_id long, ctx int, thread long, srcloc int, cpu_start long, cpu_end long, gpu_start long, gpu_end long, depth int, parent_id long, query_id int, callstack int",
    "gpu_notes": "capture_id string, ctx int, query_id int, note_id long, value double",
    "frames": "capture_id string, frame_set string, continuous boolean, idx long, start long, end_raw long, image_id int",
    "frame_images": "capture_id string, image_id int, frame_ref long, w int, h int, flip boolean, bytes binary",
    "messages": "capture_id string, seq long, time long, thread long, text string, color int, callstack int, source string, severity string",
    "plots": "capture_id string, plot string, type string, format string, show_steps boolean, fill boolean, color int",
    "plot_points": "capture_id string, plot string, seq long, time long, val double",
    "mem_ops": "capture_id string, pool string, ptr long, seq long, time long, kind string, size long, thread long, callstack int",
    "mem_events": "capture_id string, pool string, alloc_id long, ptr long, size long, time_alloc long, time_free long, thread_alloc long, thread_free long, cs_alloc int, cs_free int",
    "locks": "capture_id string, lock_id int, name string, srcloc int, type string, announce long, terminate long",
    "lock_events": "capture_id string, lock_id int, seq long, time long, thread long, type string, srcloc int",
    "context_switches": "capture_id string, thread long, start long, end long, cpu int, wakeup long, wakeup_cpu int, reason int, state int",
    "cpu_switches": "capture_id string, cpu int, start long, end long, thread long",
    "samples": "capture_id string, thread long, seq long, time long, callstack int",
    "callstacks": "capture_id string, callstack int, frames array<long>",
    "callstack_frames": "capture_id string, frame_id long, inline_idx int, name string, file string, line int, sym_addr long, image string",
    "symbols": "capture_id string, sym_addr long, name string, file string, line int, image string, call_file string, call_line int, is_inline boolean, size int",
    "hw_samples": "capture_id string, ip long, kind string, time long",
    "sections": "capture_id string, category int, id long, start long, end long, text string",
    "section_categories": "capture_id string, category int, description string",
    "threads": "capture_id string, thread long, name string, is_fiber boolean, group_hint int",
    "tid_pid": "capture_id string, tid long, pid long",
    "external_names": "capture_id string, tid long, name string, program string",
    "cpu_topology": "capture_id string, cpu int, package int, die int, core int",
    "crash": "capture_id string, thread long, time long, message string, callstack int",
    "app_info": "capture_id string, line int, text string",
    "parameters": "capture_id string, idx int, name string, type string, value int",
    "source_files": "capture_id string, file string, content string",
    "annotations": "capture_id string, text string, start long, end long, color int, visible boolean",
    "anomalies": "capture_id string, kind string, seq long, time long, thread long, detail string",
}

#: What a selective load may leave out, by class.
CLASSES: dict[str, tuple[str, ...]] = {
    "locks": ("locks", "lock_events"),
    "messages": ("messages",),
    "plots": ("plots", "plot_points"),
    "memory": ("mem_events", "mem_ops"),
    "frame_images": ("frame_images",),
    "context_switches": ("context_switches", "cpu_switches"),
    "samples": ("samples", "callstacks", "callstack_frames", "symbols", "hw_samples"),
    "symbol_code": (),
    "source_cache": ("source_files",),
}
#: Letters of the strip option.
STRIP = {"l": "locks", "m": "messages", "p": "plots", "M": "memory", "i": "frame_images", "c": "context_switches", "s": "samples", "C": "symbol_code", "S": "source_cache"}
