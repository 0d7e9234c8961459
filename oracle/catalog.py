"""Oracle SQL per query key (same keys as ``hirefold.plans.catalog``)."""

from __future__ import annotations

from oracle import funnel

ORACLES = {
    "funnel_verdict": funnel.funnel_verdict,
    "title_family": funnel.title_family,
    "location_status": funnel.location_status,
    "parse_salary_prose": funnel.parse_salary_prose,
    "comp_floor": funnel.comp_floor,
    "shape_hits": funnel.shape_hits,
}

from oracle import state  # noqa: E402

ORACLES.update({
    "sighting_history": state.sighting_history,
    "closure_events": state.closure_events,
    "public_history": state.public_history,
    "facts_closure_events": state.closure_events,
    "facts_public_store": state.public_history,
    "mirror_collapse": state.mirror_collapse,
    "seen_reconcile": state.seen_reconcile,
    "public_reconcile": state.public_reconcile,
    "new_postings": state.new_postings,
    "normalize_company": state.normalize_company,
})

from oracle import history  # noqa: E402

ORACLES.update({
    "history_suppress": history.history_suppress,
    "history_note": history.history_note,
    "liveness": history.liveness,
    "board_presence": history.board_presence,
    "route_postings": history.route_postings,
    "funnel_counts": history.funnel_counts,
})

from oracle import registry  # noqa: E402

ORACLES.update({
    "board_refs": registry.board_refs,
    "discover_orgs": registry.discover_orgs,
    "no_match_markers": registry.no_match_markers,
    "domains_to_scan": registry.domains_to_scan,
    "last_write_wins": registry.last_write_wins,
    "registry_upsert": registry.registry_upsert,
    "registry_add": registry.registry_add,
    "registry_added": registry.registry_added,
    "registry_apply_probes": registry.registry_apply_probes,
    "registry_probe_counts": registry.registry_probe_counts,
    "registry_stats": registry.registry_stats,
    "stalest_first": registry.stalest_first,
    "live_orgs": registry.live_orgs,
    "slug_lookup": registry.slug_lookup,
})

from oracle import reports  # noqa: E402

ORACLES.update({
    "latest_run_per_date": reports.latest_run_per_date,
    "weekly_report_stats": reports.weekly_report_stats,
    "weekly_new_roles": reports.weekly_new_roles,
    "weekly_closed_roles": reports.weekly_closed_roles,
    "mark_public": reports.mark_public,
    "board_open": reports.board_open,
    "board_closed": reports.board_closed,
    "board_stats": reports.board_stats,
    "mirror_counts": reports.mirror_counts,
    "public_projection": reports.public_projection,
    "company_pages": reports.company_pages,
    "company_page_roles": reports.company_page_roles,
    "pages_totals": reports.pages_totals,
    "jsonld_rows": reports.jsonld_rows,
    "sitemap_rows": reports.sitemap_rows,
    "dirname_collisions": reports.dirname_collisions,
    "digest_rows": reports.digest_rows,
    "suppressed_top": reports.suppressed_top,
})

from oracle import vendors  # noqa: E402

ORACLES.update({
    "norm_ashby": vendors.norm_ashby,
    "norm_greenhouse": vendors.norm_greenhouse,
    "norm_lever": vendors.norm_lever,
    "norm_workable": vendors.norm_workable,
    "norm_smartrecruiters": vendors.norm_smartrecruiters,
    "norm_workday": vendors.norm_workday,
    "all_postings": vendors.all_postings,
    "scan_accounting": vendors.scan_accounting,
    "probe_from_board": vendors.probe_from_board,
    "detail_enrich": vendors.detail_enrich,
    "detail_gate": vendors.detail_gate,
})

from oracle import columns  # noqa: E402

ORACLES.update({
    "html_to_text": columns.html_to_text,
    "normalize_title": columns.normalize_title,
    "location_segments": columns.location_segments,
    "annualize": columns.annualize,
    "workday_slug": columns.workday_slug,
    "flatten_locations": columns.flatten_locations,
    "parse_timestamps": columns.parse_timestamps,
    "remote_signal": columns.remote_signal,
    "comp_ashby": columns.comp_ashby,
    "comp_lever": columns.comp_lever,
})

from oracle import stores  # noqa: E402

ORACLES.update({
    "tolerant_jsonl": stores.tolerant_jsonl,
    "log_reader": stores.log_reader,
    "history_load": stores.history_load,
    "run_record": stores.run_record,
    "org_scan_list": stores.org_scan_list,
    "stream_reconcile": stores.stream_reconcile,
    "facts_seen_store": stores.stream_reconcile,
    "stream_public_reconcile": stores.stream_public_reconcile,
})

ORACLES["location_exception"] = funnel.location_exception

ORACLES["closed_lines"] = state.closed_lines

ORACLES["store_write"] = registry.registry_apply_probes
